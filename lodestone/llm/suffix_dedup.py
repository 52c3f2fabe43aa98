"""Exact removal of long repeated byte strings by a range-partitioned array of sampled suffixes.

Only suffixes at anchors are sorted: in each string of ``size`` bytes the least of its
leading grams by hash is the anchor, which equal strings have at equal places, and an
anchor owns the string starts that chose it. A string that repeats makes its owners'
suffixes agree on ``lead`` bytes at least, so

1. anchors whose leading bytes occur once go;
2. anchors whose owned strings, taken together, occur elsewhere with the same bytes around
   are settled as a whole, and one of each such class stays as a partner for the rest;
3. the remaining suffixes are dealt out by range of their leading bytes (splitters from a
   sample), so a bucket holds neighbours; each bucket is sorted by multikey quicksort, the
   common prefixes of neighbours rule out starts, and the strings left are compared;
4. a group of suffixes with equal leading bytes that touches a bucket's edge may go on in
   the next one. Across buckets first the bytes that ``BLOCK`` strings in a row have in
   common are compared, one row for all of them; strings of blocks that meet others there
   are then compared one by one. A bucket sends every block with a string still open, and
   of each other string one block that holds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from lodestone import session
from lodestone.llm import rolling, staging
from lodestone.llm.arrowtext import id_text, record

ANCHORS = pa.schema([("lead", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("doc_id", pa.int64()), ("lo", pa.int32()), ("p", pa.int32()), ("n", pa.int32()), ("more", pa.bool_()), ("again", pa.bool_())])
SUFFIXES = pa.schema([("suffix", pa.binary()), ("before", pa.binary()), ("doc_id", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("single", pa.bool_())])
FOUND = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("single", pa.bool_())])
BLOCK = 16
SAMPLES = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def anchors(staged: DataFrame, size: int, width: int, gram: int) -> DataFrame:
    lead = size - width

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = staging.Seen()
        for part, texts in staging.unpacked(batches):
            raw, rows = staging.joined_bytes(texts)
            sums = [rolling.byte_sums(raw, k) for k in (11, 12)]
            owner = rolling.owners(rolling.window_hash(sums[0], 11, gram), width)
            starts = np.flatnonzero(rolling.inside_rows(rows, min(len(owner), len(raw)), size))
            if not len(starts):
                continue
            owner = owner[starts]
            first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1)])
            lo, hi, p = starts[first], starts[np.r_[first[1:] - 1, len(starts) - 1]], owner[first]
            doc = np.searchsorted(rows, lo, side="right") - 1
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            shape = rolling.mix((p - lo).astype(np.uint64) * np.uint64(4099))
            classes = [(rolling.span_hash(s, k, lo, hi + size) ^ shape).view(np.int64) for s, k in zip(sums, (11, 12))]
            key, ids = rolling.span_hash(sums[0], 11, p, p + lead).view(np.int64), ids[doc].astype(np.int64)
            at, p, n = lo - rows[doc], p - rows[doc], hi - lo + 1
            # Of a class that repeats inside the slice one row stands for all, and of one that goes on through the task two
            # rows do; the others are settled and dealt out evenly.
            by = np.lexsort((at, ids, classes[1], classes[0], key))
            same = np.r_[False, (key[by][1:] == key[by][:-1]) & (classes[0][by][1:] == classes[0][by][:-1]) & (classes[1][by][1:] == classes[1][by][:-1])]
            again, more = np.zeros(len(by), bool), np.zeros(len(by), bool)
            again[by], more[by] = same, np.r_[same[1:], False]
            again |= seen.times(classes[0], classes[1], ids) > 1
            seen.add(*(x[~again] for x in (*classes, ids)), 1 + more[~again])
            key = np.where(again, rolling.mix((ids * 1_000_003 + at).astype(np.uint64)).view(np.int64), key)
            yield record(ANCHORS, key, *classes, ids, at.astype(np.int32), p.astype(np.int32), n.astype(np.int32), more, again)

    return staged.mapInArrow(find, "lead long, c1 long, c2 long, doc_id long, lo int, p int, n int, more boolean, again boolean")


def suffixes(staged: DataFrame, chosen: DataFrame, size: int) -> DataFrame:
    """The bytes of the chosen anchors' suffixes as far as owned strings reach, and those before them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in staging.unpacked(batches, 1 << 18):
            (lo, row), (p, _), (count, _), (single, _) = (staging.flat(part, c) for c in ("lo", "p", "n", "single"))
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            after = [texts[r][b : a + k - 1 + size] for r, a, b, k in zip(row, lo, p, count)]
            before = [texts[r][a:b] for r, a, b in zip(row, lo, p)]
            if after:
                yield record(SUFFIXES, after, before, ids[row], lo.astype(np.int32), count.astype(np.int32), single.astype(bool))

    return staging.with_lists(staged, chosen, "inner").mapInArrow(cut, "suffix binary, before binary, doc_id long, lo int, n int, single boolean")


def multikey_quicksort(strings: list[bytes], word: int = 8) -> np.ndarray:
    """Order of ``strings``: three-way partition by the word at one depth; only equals go deeper."""
    sizes = np.array([len(s) for s in strings])
    depth = -(-int(sizes.max(initial=0)) // word)
    data = np.frombuffer(b"".join(s.ljust(depth * word, b"\0") for s in strings), ">u8").reshape(len(strings), depth) if depth else np.empty((len(strings), 0), ">u8")
    out, stack = [], [(np.arange(len(strings)), 0)]
    while stack:
        rows, at = stack.pop()
        if len(rows) <= 1 or at >= depth:
            out.append(rows[np.argsort(sizes[rows], kind="stable")])
        elif len(rows) <= 24:
            out.append(np.array(sorted(rows, key=lambda r: strings[r])))
        else:
            words = data[rows, at]
            pivot = np.partition(words, len(rows) // 2)[len(rows) // 2]
            stack += [(rows[words > pivot], at), (rows[words == pivot], at + 1), (rows[words < pivot], at)]
    return np.concatenate(out) if out else np.empty(0, np.int64)


def common_prefixes(strings: list[bytes]) -> np.ndarray:
    """Bytes that each string shares with the next (one entry fewer than strings)."""
    out = np.zeros(max(0, len(strings) - 1), np.int64)
    for i, (a, b) in enumerate(zip(strings, strings[1:])):
        short = min(len(a), len(b))
        if a[:short] == b[:short]:
            out[i] = short
        else:
            out[i] = np.argmax(np.frombuffer(a, np.uint8, short) != np.frombuffer(b, np.uint8, short))
    return out


def compare_bucket(rows: dict, size: int, lead: int) -> tuple[tuple, tuple]:
    """Of one bucket: starts that repeat in it, and of its edge groups a row for each block of starts that may go on repeating beyond."""
    order = multikey_quicksort(rows["suffix"])
    suffix = [rows["suffix"][i] for i in order]
    before = [rows["before"][i] for i in order]
    doc_id, lo, count, single = (rows[k][order] for k in ("doc_id", "lo", "n", "single"))
    shared = common_prefixes(suffix)
    fresh = np.r_[True, shared < lead]
    group = np.cumsum(fresh) - 1
    edge = (group == 0) | (group == group[-1])
    most = np.maximum(np.r_[0, shared], np.r_[shared, 0])
    # A start d bytes before the anchor needs size - d common bytes from the anchor on; what stands at a bucket's end may have a closer neighbour beyond.
    most[[0, -1]] = size
    offset = np.array([len(b) for b in before], np.int64)
    skip = np.maximum(0, offset - count + 1)  # least d of each anchor
    low = np.maximum(skip, size - most)
    left = np.maximum(0, np.minimum(count, offset - low + 1))
    each = np.repeat(np.arange(len(suffix)), left)
    start = np.arange(len(each)) - np.repeat(np.cumsum(left) - left, left)
    raw, at = staging.joined_bytes([b + s for b, s in zip(before, suffix)])
    pos = at[each] + start
    h1, h2 = (rolling.window_hash(rolling.byte_sums(raw, k), k, size)[pos] for k in (13, 14))
    by = np.lexsort((h2, h1))
    same = np.r_[False, (h1[by][1:] == h1[by][:-1]) & (h2[by][1:] == h2[by][:-1])]
    run = np.cumsum(~same) - 1
    again = np.zeros(len(by), bool)
    if len(by):
        again[by] = np.bincount(run)[run] > 1
    hit = again & single[each]
    repeats = (doc_id[each][hit], lo[each][hit] + start[hit])
    # Edge groups: blocks of starts, aligned to the anchor so that equal strings lie in equal blocks.
    here = np.flatnonzero(edge[each])
    code = each[here] * 4096 + (offset[each[here]] - start[here]) // BLOCK
    codes, back = np.unique(code, return_inverse=True)
    if not len(codes):
        empty = np.empty(0, np.int64)
        return repeats, (empty, empty, empty, empty, empty, empty.astype(bool))
    count_in, first_start = np.bincount(back), np.full(len(codes), 1 << 40)
    np.minimum.at(first_start, back, start[here])
    open_in = np.zeros(len(codes), bool)
    open_in[back[single[each[here]] & ~again[here]]] = True
    member = codes // 4096
    core = at[member] + offset[member] - codes % 4096 * BLOCK
    c1, c2 = (rolling.span_hash(rolling.byte_sums(raw, k), k, core, core + size - BLOCK + 1).view(np.int64) for k in (13, 14))
    # Blocks of one core may hold different strings: of each string one block is sent, an open one where there is any.
    text = np.empty(len(by), np.int64)
    text[by] = run
    held = text[here]
    order = np.lexsort((back, ~open_in[back], held))
    send = open_in.copy()
    send[back[order[np.r_[True, held[order][1:] != held[order][:-1]]]]] = True
    return repeats, (c1[send], c2[send], doc_id[member][send], (lo[member] + first_start)[send], count_in[send], open_in[send])


def runs(doc_id: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts in a row as (doc_id, first, how many)."""
    order = np.lexsort((start, doc_id))
    doc_id, start = doc_id[order], start[order]
    new = np.flatnonzero(np.r_[True, (doc_id[1:] != doc_id[:-1]) | (start[1:] != start[:-1] + 1)]) if len(start) else np.empty(0, np.int64)
    return doc_id[new], start[new], np.diff(np.r_[new, len(start)])


def compare(sorted_suffixes: DataFrame, size: int, lead: int) -> DataFrame:
    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches), schema=SUFFIXES)
        if not held.num_rows:
            return
        rows = {c: held.column(c).to_pylist() if c in ("suffix", "before") else held.column(c).to_numpy() for c in held.column_names}
        (ids, starts), (h1, h2, edge_ids, edge_starts, counts, single) = compare_bucket(rows, size, lead)
        ids, starts, count = runs(ids, starts)
        if len(ids):
            yield record(FOUND, pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.int64()), ids, starts.astype(np.int32), count.astype(np.int32), np.ones(len(ids), bool))
        if len(h1):
            yield record(FOUND, h1, h2, edge_ids, edge_starts.astype(np.int32), counts.astype(np.int32), single)

    return sorted_suffixes.mapInArrow(bucket, "h1 long, h2 long, doc_id long, lo int, n int, single boolean")


def strings(staged: DataFrame, chosen: DataFrame, size: int) -> DataFrame:
    """Hashes of every string of the chosen starts (doc_id, lo, n, single), a row each."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in staging.unpacked(batches):
            raw, rows = staging.joined_bytes(texts)
            (lo, row), (count, _), (single, _) = (staging.flat(part, c) for c in ("lo", "n", "single"))
            each = np.repeat(np.arange(len(lo)), count)
            pos = lo[each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
            at = rows[row[each]] + pos
            h1, h2 = (rolling.span_hash(rolling.byte_sums(raw, k), k, at, at + size).view(np.int64) for k in (13, 14))
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)[row[each]]
            yield record(FOUND, h1, h2, ids, pos.astype(np.int32), np.ones(len(pos), np.int32), single[each].astype(bool))

    return staging.with_lists(staged, chosen, "inner").mapInArrow(emit, "h1 long, h2 long, doc_id long, lo int, n int, single boolean")


def shared(rows: DataFrame) -> DataFrame:
    """Of rows with two hashes those that another row has too."""
    times = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    return rows.join(times.hint("merge"), ["h1", "h2"], "left_semi")


def repeated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 400, width: int = 256, gram: int = 24, bucket_bytes: int = 3 << 20) -> DataFrame:
    """Per document: bytes, bytes and maximal runs that go because a string of ``size`` over them starts elsewhere too, and the bytes left.

    Null, empty and short texts have no such string. Rows without an id take no part. Rows
    that repeat an id are one document more each. An empty table gives an empty result;
    other columns are ignored. What is left may end inside a character, so it is binary.
    """
    run = lambda given, id_col: _repeated(given, id_col, text_col, size, width, gram, bucket_bytes)
    return staging.with_unique_ids(docs, id_col, text_col, run).unionByName(untouched(docs, id_col, text_col))


def _repeated(docs: DataFrame, id_col: str, text_col: str, size: int, width: int, gram: int, bucket_bytes: int) -> DataFrame:
    staged, n = staging.stage(docs, id_col, text_col)
    lead = size - width
    spark = docs.sparkSession
    found = staging.bucketed(anchors(staged, size, width, gram), "anchors", n, "lead", ["lead", "c1", "c2"])
    marked = found.withColumn("times", F.sum(F.when(F.col("more") | F.col("again"), 2).otherwise(1)).over(W.partitionBy("lead", "c1", "c2"))).withColumn("rank", F.row_number().over(W.partitionBy("lead", "c1", "c2").orderBy("doc_id", "lo")))
    same_lead = W.partitionBy("lead")  # settled rows have one each to themselves
    marked = marked.withColumn("open", (F.min("c1").over(same_lead) != F.max("c1").over(same_lead)) & (F.min("times").over(same_lead) == 1))
    marked = session.stored(marked.filter("times > 1 or open").select("doc_id", "lo", "p", "n", "times", "rank", "open"), "classes")
    staging.discard(found)
    whole = marked.filter("times > 1").select("doc_id", "lo", "n")
    chosen = marked.filter("rank = 1 and open").select("doc_id", "lo", "p", "n", (F.col("times") == 1).alias("single"))
    cut = session.stored(suffixes(staged, chosen, size), "suffixes")
    total = cut.agg(F.sum(F.length("suffix") + F.length("before"))).first()[0] or 0
    # Splitters are whole suffixes and what stands before them, so that many equal suffixes can be dealt out; few samples a bucket keep what the driver gets small.
    samples = spark.conf.get(SAMPLES)
    spark.conf.set(SAMPLES, "12")
    try:
        found = session.stored(compare(cut.repartitionByRange(max(1, total // bucket_bytes), "suffix", "before"), size, lead), "found")
    finally:
        spark.conf.set(SAMPLES, samples)
    session.drop_path(spark, cut.path)
    blocks = session.stored(shared(found.filter("h1 is not null")).select("doc_id", "lo", "n", "single"), "blocks")
    met = session.stored(shared(strings(staged, blocks, size)).filter("single").select("doc_id", "lo", "n"), "met")
    spans = whole.unionByName(found.filter("h1 is null").select("doc_id", "lo", "n")).unionByName(met)

    def remove(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in staging.unpacked(parts):
            raw, at = staging.joined_bytes(texts)
            (lo, row), (count, _) = staging.flat(part, "lo"), staging.flat(part, "n")
            lo, count = lo.astype(np.int64), count.astype(np.int64)
            edge = np.zeros(len(raw) + 1, np.int64)
            np.add.at(edge, at[row] + lo, 1)
            np.add.at(edge, at[row] + lo + count + size - 1, -1)
            gone = np.cumsum(edge)[:-1] > 0
            opens = gone & ~np.r_[False, gone[:-1]]
            opens[at[:-1][at[:-1] < len(raw)]] |= gone[at[:-1][at[:-1] < len(raw)]]
            removed, spans_in = (np.diff(np.r_[0, np.cumsum(x)][at]) for x in (gone, opens))
            kept = [raw[a:b][~gone[a:b]].tobytes() if r else t for t, a, b, r in zip(texts, at, at[1:], removed)]
            yield record(RESULT, part.column("doc_id"), np.diff(at), removed, spans_in, kept)

    return staging.with_lists(staged, spans, "left").mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def untouched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows without an id, as they are."""
    rows = id_text(docs.filter(F.col(id_col).isNull()), id_col, text_col)
    none = F.lit(0).cast("long")
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.encode("text", "utf-8").alias("kept"))
