"""Substring deduplication over words by a log-structured index of window fingerprints.

A window is ``size`` consecutive words. Of the grams (``gram`` words) inside a window the
least by hash is its anchor, which depends on nothing but the window's words, so equal
windows have equal anchors at equal places. The index holds a row for each anchor: the
fingerprint of its gram, a hash of all words of the windows that it owns (its class), and
where they stand. Only the first occurrence of a class is kept.

Rows live in immutable runs, dealt to buckets by fingerprint and sorted. A batch of
documents makes a run of its own; that run is merge-joined with the runs of history (same
buckets, so nothing moves): a class that history or an earlier document has is repeated as
a whole. Anchors whose fingerprint also occurs with other words around it are verified
on the texts, window by window. Then the run joins the index; from ``fan_in`` runs on they
are compacted into one.

What is indexed before counts as earlier. ``repeated`` deals one table to batches in
ascending order of ids; an index with a folder of its own can be opened again in a later
session and given the next batch.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from lodestone import session
from lodestone.llm import rolling, staging
from lodestone.llm.arrowtext import by_bytes, id_text, record

#: The columns of a run that stays in the index.
KEPT = "fp long, cls long, src int, doc_id long, lo int, n int"
RUN = "fp long, cls long, doc_id long, lo int, n int, again boolean"
RUN_ARROW = pa.schema([("fp", pa.int64()), ("cls", pa.int64()), ("doc_id", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("again", pa.bool_())])
WINDOWS = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("old", pa.bool_()), ("again", pa.bool_())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _words(texts: list[bytes]):
    raw, offsets = staging.joined_bytes(texts)
    starts, ends, rows = rolling.word_spans(raw, offsets)
    return rolling.word_hashes(raw, starts, ends, 1), rolling.word_hashes(raw, starts, ends, 2), rows


def anchors(staged: DataFrame, size: int, gram: int) -> DataFrame:
    width = size - gram + 1

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = staging.Seen()
        for part, texts in staging.unpacked(batches):
            one, two, rows = _words(texts)
            sums, sums2 = rolling.prefix_sums(one, 3), rolling.prefix_sums(two, 4)
            grams = rolling.window_hash(sums, 3, gram)
            owner = rolling.owners(grams, width)
            starts = np.flatnonzero(rolling.inside_rows(rows, len(owner), size))
            owner = owner[starts]
            if not len(starts):
                continue
            first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1)])
            lo, hi = starts[first], starts[np.r_[first[1:] - 1, len(starts) - 1]]
            doc = np.searchsorted(rows, lo, side="right") - 1
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            shape = rolling.mix((owner[first] - lo).astype(np.uint64) * np.uint64(4099))
            # Rows are told apart by both: the fingerprint is by one family of hashes, the class by another.
            classes = (rolling.span_hash(sums2, 4, lo, hi + size) ^ shape).view(np.int64)
            fp, ids, at, n = grams[owner[first]].view(np.int64), ids[doc].astype(np.int64), lo - rows[doc], hi - lo + 1
            again = rolling.repeats(fp, classes, ids, at) | (seen.times(fp, classes, ids) > 0)
            seen.add(fp[~again], classes[~again], ids[~again])
            # What repeats inside the task is settled; it needs no fingerprint, so it is dealt out evenly.
            fp = np.where(again, rolling.mix((ids * 1_000_003 + at).astype(np.uint64)).view(np.int64), fp)
            yield record(RUN_ARROW, fp, classes, ids, at.astype(np.int32), n.astype(np.int32), again)

    return staged.mapInArrow(find, RUN)


def windows(staged: DataFrame, chosen: DataFrame, size: int) -> DataFrame:
    """Two hashes of every window that the chosen anchors own, from the texts.

    Of equal windows in one slice of documents (they come in order) the first one counts
    and the others are marked ``again``, as are those that the task has seen in documents
    with smaller ids, so a frequent window is a row a task later on.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = staging.Seen()
        for part, texts in staging.unpacked(batches):
            one, two, rows = _words(texts)
            h1 = rolling.window_hash(rolling.prefix_sums(one, 5), 5, size)
            h2 = rolling.window_hash(rolling.prefix_sums(two, 6), 6, size)
            (lo, row), (count, _), (old, _) = (staging.flat(part, c) for c in ("lo", "n", "old"))
            each = np.repeat(np.arange(len(lo)), count)
            pos = lo[each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
            at = rows[row[each]] + pos
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)[row[each]]
            h1, h2, old = h1[at].view(np.int64), h2[at].view(np.int64), old[each].astype(bool)
            by = np.lexsort((pos, ids, h2, h1))
            h1, h2, ids, pos, old = h1[by], h2[by], ids[by], pos[by], old[by]
            same = np.r_[False, (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])]
            first = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
            again = same & ((ids != ids[first]) | (pos != pos[first])) | (seen.times(h1, h2, ids) > 0)
            seen.add(h1[~again], h2[~again], ids[~again])
            keep = ~(again & old)
            yield record(WINDOWS, h1[keep], h2[keep], ids[keep], pos[keep].astype(np.int32), old[keep], again[keep])

    return staging.with_lists(staged, chosen.select("doc_id", "lo", "n", "old"), "inner").mapInArrow(emit, "h1 long, h2 long, doc_id long, pos int, old boolean, again boolean")


class FingerprintIndex:
    """Sorted runs of anchor rows, and the texts that they stand in; ``add`` takes batch after batch.

    With a ``folder`` (shared by all executors) tables and a manifest live there, and ``open``
    finds them again in another session.
    """

    def __init__(self, spark: SparkSession, buckets: int, *, size: int = 20, gram: int = 6, fan_in: int = 2, folder: str | None = None):
        self.spark, self.buckets, self.size, self.gram, self.fan_in, self.folder = session.prepare(spark), buckets, size, gram, fan_in, folder
        self.texts: list[DataFrame] = []
        self.runs: list[DataFrame] = []

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> FingerprintIndex:
        kept = json.loads(session.read_text(spark, f"{folder}/manifest.json"))
        index = cls(spark, kept["buckets"], size=kept["size"], gram=kept["gram"], fan_in=kept["fan_in"], folder=folder)
        index.texts = [staging.attached(spark, path, "doc_id long, packed binary", kept["buckets"], "doc_id") for path in kept["texts"]]
        index.runs = [staging.attached(spark, path, KEPT, kept["buckets"], "fp") for path in kept["runs"]]
        return index

    def _save(self) -> None:
        if self.folder:
            paths = {"texts": [t.written[1] for t in self.texts], "runs": [r.written[1] for r in self.runs]}
            held = {"buckets": self.buckets, "size": self.size, "gram": self.gram, "fan_in": self.fan_in} | paths
            session.write_text(self.spark, f"{self.folder}/manifest.json", json.dumps(held))

    def _path(self, label: str) -> str | None:
        return f"{self.folder}/{label}-{uuid.uuid4().hex}" if self.folder else None

    def dedupe(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """A batch's rows as ``repeated`` returns them, judged against all batches before it and itself, and then part of the index."""

        def run(given: DataFrame, id_col: str) -> DataFrame:
            staged, _ = staging.stage(given, id_col, text_col, self.buckets, self._path("texts"))
            self.texts.append(staged)
            return removed(staged, self.add(staged), self.size)

        return staging.with_unique_ids(docs, id_col, text_col, run).unionByName(untouched(docs, id_col, text_col))

    def add(self, batch: DataFrame) -> DataFrame:
        """Index a batch (rows of the last of ``texts``); returns (doc_id, lo, n): runs of window starts that repeat something earlier."""
        new = staging.bucketed(anchors(batch, self.size, self.gram), "run", self.buckets, "fp", ["fp", "cls", "doc_id", "lo"])
        history = self.runs
        marked = new.withColumn("rank", F.row_number().over(W.partitionBy("fp", "cls").orderBy("doc_id", "lo")))
        marked = marked.withColumn("known", F.lit(False)).withColumn("met", F.lit(False))
        for past in history:
            same = past.select("fp", "cls", F.lit(True).alias("same"))
            near = past.select("fp").distinct().withColumn("near", F.lit(True))
            marked = marked.join(same.hint("merge"), ["fp", "cls"], "left").join(near.hint("merge"), "fp", "left")
            marked = marked.withColumn("known", F.col("known") | F.coalesce("same", F.lit(False))).withColumn("met", F.col("met") | F.coalesce("near", F.lit(False))).drop("same", "near")
        fresh = (F.col("rank") == 1) & ~F.col("known") & ~F.col("again")
        kinds = W.partitionBy("fp")
        marked = marked.withColumn("mixed", F.min("cls").over(kinds) != F.max("cls").over(kinds))
        source = len(self.texts) - 1
        rows = marked.select("fp", "cls", F.lit(source).alias("src"), "doc_id", "lo", "n", fresh.alias("fresh"), (F.col("mixed") | F.col("met")).alias("unsure"), "met")
        run = staging.bucketed(rows, "marked", self.buckets, "fp", ["fp", "cls"], dealt=True)
        staging.discard(new)
        whole = session.stored(run.filter("not fresh").select("doc_id", "lo", "n"), "whole")
        chosen = run.filter("fresh and unsure").select("src", "doc_id", "lo", "n", F.lit(False).alias("old"))
        asked = run.filter("fresh and met").select("fp").distinct()
        for past in history:
            chosen = chosen.unionByName(past.join(asked.hint("merge"), "fp", "left_semi").select("src", "doc_id", "lo", "n", F.lit(True).alias("old")))
        if len(self.texts) > 1:
            chosen = session.stored(chosen, "chosen")
        of_texts = (windows(t, chosen.filter(F.col("src") == k), self.size) for k, t in enumerate(self.texts))
        found = session.stored(reduce(DataFrame.unionByName, of_texts), "windows")
        place = W.partitionBy("h1", "h2").orderBy(F.desc("old"), "doc_id", "pos")
        spot = F.struct("old", "doc_id", "pos")
        later = found.filter("not again").withColumn("first", F.first(spot).over(place)).filter("not old").filter(spot != F.col("first"))
        again = session.stored(found.filter("again and not old").select("doc_id", "pos").unionByName(later.select("doc_id", "pos")).select("doc_id", F.col("pos").alias("lo"), F.lit(1).alias("n")), "again")
        session.drop_path(self.spark, found.path)
        self._keep([*self.runs, run] if len(self.runs) + 1 >= self.fan_in else [run])
        return whole.unionByName(again)

    def _keep(self, runs: list[DataFrame]) -> None:
        """One run of all given: they lie in the same buckets, so each task merges its own and nothing moves."""
        kept = reduce(DataFrame.unionByName, [r.select("fp", "cls", "src", "doc_id", "lo", "n") if r in self.runs else r.filter("fresh").select("fp", "cls", "src", "doc_id", "lo", "n") for r in runs])
        merged = staging.bucketed(kept, "run", self.buckets, "fp", ["fp", "cls"], dealt=True, path=self._path("run"))
        self.runs = [r for r in self.runs if r not in runs] + [merged]
        self._save()
        staging.discard(*runs)

    def discard(self) -> None:
        staging.discard(*self.runs)


def removed(staged: DataFrame, spans: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of each document, given its runs of window starts that go."""

    def remove(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in staging.unpacked(parts):
            words = [t.split() for t in texts]
            offsets = np.zeros(len(words) + 1, np.int64)
            np.cumsum([len(w) for w in words], out=offsets[1:])
            (lo, row), (count, _) = staging.flat(part, "lo"), staging.flat(part, "n")
            edge = np.zeros(offsets[-1] + 1, np.int64)
            np.add.at(edge, offsets[row] + lo.astype(np.int64), 1)
            np.add.at(edge, offsets[row] + lo.astype(np.int64) + count.astype(np.int64) + size - 1, -1)
            keep = np.cumsum(edge)[:-1] == 0
            gone = np.r_[0, np.cumsum(~keep)][offsets]
            kept = [b" ".join(compress(w, keep[a:b]) if g else w).decode() for w, a, b, g in zip(words, offsets, offsets[1:], np.diff(gone))]
            yield record(RESULT, part.column("doc_id"), [len(w) for w in words], np.diff(gone), kept)

    return staging.with_lists(staged, spans, "left").mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept string")


def untouched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows without an id, as they are."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, 1 << 20):
            split = [t.encode().split() for t in part.column("text").to_pylist()]
            yield record(RESULT, part.column("doc_id"), [len(w) for w in split], [0] * len(split), [b" ".join(w).decode() for w in split])

    return id_text(docs.filter(F.col(id_col).isNull()), id_col, text_col).mapInArrow(words, "doc_id long, n_words long, n_removed long, kept string")


def repeated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 20, gram: int = 6, batches: int = 2, fan_in: int = 2) -> DataFrame:
    """Per document: its words, how many go because a window over them starts earlier, and the rest.

    Null, empty and short texts have no windows. Rows without an id take no part and keep
    their words. Rows that repeat an id are documents of their own, in the order of their
    texts' MD5. An empty table gives an empty result; other columns are ignored.
    """

    def run(given: DataFrame, id_col: str) -> DataFrame:
        staged, n = staging.stage(given, id_col, text_col)
        cuts = staged.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
        index, spans, below = FingerprintIndex(given.sparkSession, n, size=size, gram=gram, fan_in=fan_in), [], None
        index.texts = [staged]
        for cut in sorted({int(c) for c in cuts}) + [None]:
            batch = staged if below is None else staged.filter(F.col("doc_id") > below)
            spans.append(index.add(batch if cut is None else batch.filter(F.col("doc_id") <= cut)))
            below = cut
        index.discard()
        return removed(staged, reduce(DataFrame.unionByName, spans), size)

    return staging.with_unique_ids(docs, id_col, text_col, run).unionByName(untouched(docs, id_col, text_col))
