"""Exact n-gram Jaccard self-join by grouped prefixes, and the classes that its links form.

A document's set holds the hashes of its distinct word shingles. In one order of all
shingles (those known to be frequent last, else by hash) the first n - ceil(t n) + 1 of a
set are its prefix, and two sets that reach the threshold share a shingle of their
prefixes. The work goes down in steps:

1. equal sets collapse into one node;
2. nodes with equal prefixes and sizes collapse into one group, and its members are
   verified against its first node: those that link make a unit, the others stand alone;
3. units that share a prefix shingle meet if sizes, positions and the number of shared
   prefix shingles allow the threshold: every one with the first of its shingle's list,
   and all with all in short lists;
4. pairs are verified on whole sets. Where two units on a list are not in one class by
   then, they are verified too, unless the distances to the list's first exclude a link
   (Jaccard distance is a metric). Units whose first nodes are near but not linked are
   expanded into members, with the same exclusion.

So no pair that could change a class goes unverified, and a large class costs about a
pair for each member and list instead of all pairs.

Frequent shingles are a hint for the order and never change the result. They number
``hot_limit`` at most, which bounds the broadcast side at 8 bytes each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from lodestone import session
from lodestone.llm import rolling, staging
from lodestone.llm.arrowtext import by_bytes, id_text
from lodestone.llm.components import components

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted hashes of the distinct k-word shingles, A-Z folded; the whole sequence where there are fewer words."""
    raw, offsets = staging.joined_bytes(texts)
    raw = _FOLD[raw]
    starts, ends, rows = rolling.word_spans(raw, offsets)
    sums = rolling.prefix_sums(rolling.word_hashes(raw, starts, ends, 31), 32)
    out = []
    for a, b in zip(rows, rows[1:]):
        if b - a >= k:
            at = np.arange(a, b - k + 1)
            out.append(np.unique(rolling.span_hash(sums, 32, at, at + k)))
        else:
            out.append(rolling.span_hash(sums, 32, np.array([a]), np.array([b])) if b > a else np.empty(0, np.uint64))
    return out


def frequent(staged: DataFrame, k: int, hot_least: int, hot_limit: int) -> np.ndarray:
    """Hashes, sorted, of shingles that partitions see in many documents; ``hot_limit`` of them at most by their sum."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            values, times = np.unique(np.concatenate(held), return_counts=True)
            many = times > 1
            return pa.RecordBatch.from_arrays([pa.array(np.r_[values[many].view(np.int64), [0]]), pa.array(np.r_[times[many], [size]].astype(np.int64)), pa.array(np.r_[np.zeros(many.sum(), bool), [True]])], ["h", "times", "total"])

        for _, texts in staging.unpacked(batches):
            sets = shingle_sets(texts, k)
            held += sets
            size += sum(map(len, sets))
            if size >= 6_000_000:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    seen = session.stored(staged.mapInArrow(count, "h long, times long, total boolean").groupBy("total", "h").agg(F.sum("times").alias("times")).filter(f"total or times >= {hot_least}"), "frequent")
    shingles = seen.filter("total").agg(F.sum("times")).first()[0] or 0
    least = max(hot_least, shingles // hot_limit + 1)
    return np.sort(seen.filter(f"not total and times >= {least}").select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64))


def digest(values: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits that stand for a sequence of hashes."""
    mixed = rolling.mix(values + np.arange(1, len(values) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return mixed.sum(), rolling.mix(mixed ^ np.uint64(77)).sum()


def prefixes(staged: DataFrame, hot, k: int, percent: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in staging.unpacked(batches):
            sets = shingle_sets(texts, k)
            often = hot.value
            heads, digests, cold = [], [], []
            for s in sets:
                n = len(s)
                take = n - (percent * n + 99) // 100 + 1 if n else 0
                if len(often) and n:
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    late = often[at] == s
                    head = np.r_[s[~late], s[late]][:take]
                    cold.append(min(len(head), int((~late).sum())))
                else:
                    head = s[:take]
                    cold.append(len(head))
                heads.append(head.view(np.int64))
                digests.append((*digest(s), *digest(head)))
            ends = np.r_[0, np.cumsum([len(h) for h in heads])].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(heads)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(np.array([d[i] for d in digests], np.uint64).view(np.int64)) for i in range(4)), pa.array(cold, pa.int32()), lists], ["doc_id", "n", "d1", "d2", "g1", "g2", "cold", "head"])

    return staged.mapInArrow(cut, "doc_id long, n long, d1 long, d2 long, g1 long, g2 long, cold int, head array<long>")


def node_sets(staged: DataFrame, n: int, nodes: DataFrame, k: int) -> DataFrame:
    """(node, bytes of its sorted set), dealt to buckets by node."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in staging.unpacked(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s.tobytes() for s in shingle_sets(texts, k)], pa.binary())], ["node", "s"])

    rows = staged.join(nodes.select(F.col("node").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    return staging.bucketed(rows.select("doc_id", "packed").mapInArrow(sets, "node long, s binary"), "sets", n, "node", ["node"], dealt=True)


def verified(pairs: DataFrame, sets: DataFrame, partners: int = 256) -> DataFrame:
    """(a, b, common, na, nb) of each pair, from the whole sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for part in batches:
            a, b = part.column("a"), part.column("b")
            common, na, nb = [], [], []
            for x, sa, sb in zip(a.to_pylist(), part.column("sa"), part.column("sb")):
                if x != last:
                    last, left = x, np.frombuffer(sa.as_buffer(), np.uint64)
                right = np.frombuffer(sb.as_buffer(), np.uint64)
                small, large = (left, right) if len(left) <= len(right) else (right, left)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                common.append(int((large[at] == small).sum()))
                na.append(len(left))
                nb.append(len(right))
            yield pa.RecordBatch.from_arrays([a, b, *(pa.array(x, pa.int64()) for x in (common, na, nb))], ["a", "b", "common", "na", "nb"])

    # A node with many partners has its set sent to several tasks, which share the partners by their number.
    crowded = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("partners")).filter(f"partners > {partners}").select("a", F.ceil(F.col("partners") / partners).cast("int").alias("parts"))
    pairs = pairs.join(crowded, "a", "left").select("a", "b", F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("b"), "parts").cast("int")).alias("part"))
    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")).hint("merge"), "b")
    of_a = sets.join(crowded.withColumnRenamed("a", "node"), "node", "left").select(F.col("node").alias("a"), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.col("s").alias("sa"))
    with_a = with_b.join(of_a.hint("merge"), ["a", "part"])
    return with_a.select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long, common long, na long, nb long")


def linked(percent: int):
    return F.expr(f"100 * common >= {percent} * (na + nb - common)")


def jaccard_distance():
    return F.expr("1.0D - common / (na + nb - common)")


def common_least(percent: int, n1: str, n2: str) -> str:
    """Shingles that two sets of these sizes must share to link."""
    return f"ceil({percent} * ({n1} + {n2}) / {100.0 + percent} - 1e-9)"


def enough_shared(percent: int, shared: str):
    """Whether two units can link by the prefix shingles they share.

    Of the prefix that ends first all common shingles are in the other prefix too, and no
    more than n minus the common ones may be missing there. ``shared`` counts those on
    short lists; on long lists they share no more than the fewer such shingles of the two.
    """
    need = [f"take_{x} - (n_{x} - {common_least(percent, 'n_a', 'n_b')})" for x in "ab"]
    return F.expr(f"{shared} + least(long_a, long_b) >= least({need[0]}, {need[1]})")


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85, short_list: int = 32, hot_least: int = 16, hot_limit: int = 4_000_000) -> DataFrame:
    """Per document: size of its set, its class (least id reachable by links, itself included).

    Texts without words have an empty set and link with nothing. Rows without an id have no
    class (null) and no part in others. Rows that repeat an id are documents of their own,
    each with its class. An empty table gives an empty result; other columns are ignored.
    """
    run = lambda given, id_col: _join(given, id_col, text_col, k, percent, short_list, hot_least, hot_limit)
    return staging.with_unique_ids(docs, id_col, text_col, run, ("doc_id", "component_id")).unionByName(alone(docs, id_col, text_col, k))


def alone(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """The rows without an id."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, 1 << 20):
            n = [len(s) for s in shingle_sets([t.encode() for t in part.column("text").to_pylist()], k)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.nulls(len(n), pa.int64())], ["doc_id", "n_shingles", "component_id"])

    return id_text(docs.filter(F.col(id_col).isNull()), id_col, text_col).mapInArrow(sizes, "doc_id long, n_shingles long, component_id long")


def _join(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, short_list: int, hot_least: int, hot_limit: int) -> DataFrame:
    spark, before = docs.sparkSession, session.made()
    staged, n = staging.stage(docs, id_col, text_col)
    hot = spark.sparkContext.broadcast(frequent(staged, k, hot_least, hot_limit))
    every = staging.bucketed(prefixes(staged, hot, k, percent), "prefixes", n, "doc_id", ["doc_id"], dealt=True)
    nodes = session.stored(every.filter("n > 0").groupBy("n", "d1", "d2", "g1", "g2").agg(F.min("doc_id").alias("node")), "nodes")
    grouped = nodes.groupBy("n", "g1", "g2").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("members"))
    members = session.stored(nodes.join(grouped.hint("merge"), ["n", "g1", "g2"]).select("node", "n", "first", "members"), "members")

    # Members against their group's first. One that doesn't link stands on the group's lists as a unit of its own.
    crowd = members.filter("members > 1")
    written = [crowd_sets := node_sets(staged, n, session.stored(crowd.select("node"), "crowd"), k)]
    inside = session.stored(verified(crowd.filter("node != first").select(F.col("first").alias("a"), F.col("node").alias("b")), crowd_sets), "inside")
    reach = inside.filter(linked(percent)).groupBy("a").agg(F.max(jaccard_distance()).alias("reach")).withColumnRenamed("a", "unit")
    alone = inside.filter(~linked(percent)).select(F.col("b").alias("unit"))
    units = members.filter("node = first").select(F.col("node").alias("unit")).unionByName(alone)

    # Lists of units by prefix shingle; only lists of two or more matter.
    heads = every.join(units.withColumnRenamed("unit", "doc_id").hint("merge"), "doc_id")
    postings = heads.select(F.col("doc_id").alias("unit"), (F.col("n") * (1 << 31) + F.size("head")).alias("sizes"), "cold", F.posexplode("head").alias("pos", "t"))
    size, pivot = F.count(F.lit(1)), F.min(F.struct("unit", "sizes", "pos"))
    on_list, cold, often = W.partitionBy("t"), postings.filter("pos < cold").drop("cold"), postings.filter("pos >= cold").drop("cold")
    cold = cold.withColumn("size", size.over(on_list)).filter("size > 1").withColumn("p", pivot.over(on_list))
    # Facts of a frequent shingle's list are summed before they meet it, and a join can be split where a list is long; a window could not.
    often = often.join(often.groupBy("t").agg(size.alias("size"), pivot.alias("p")).filter("size > 1").hint("merge"), "t")
    postings = cold.unionByName(often)
    lists = session.stored(postings.select("t", "unit", F.shiftright("sizes", 31).alias("n"), (F.col("sizes") % (1 << 31)).alias("take"), "pos", "size", F.col("p.unit").alias("pivot"), F.shiftright("p.sizes", 31).alias("pivot_n"), F.col("p.pos").alias("pivot_pos")), "lists")
    facts = lists.groupBy("unit").agg(F.max("n").alias("n"), F.max("take").alias("take"), F.sum((F.col("size") > short_list).cast("long")).alias("long"))
    facts = session.stored(facts.join(reach, "unit", "left").fillna(0.0, ["reach"]), "facts")

    def may_link(n1: str, p1: str, n2: str, p2: str):
        return F.expr(f"100 * least({n1}, {n2}) >= {percent} * greatest({n1}, {n2}) and least({n1} - {p1}, {n2} - {p2}) + least({p1}, {p2}) >= {common_least(percent, n1, n2)}")

    star = lists.filter("unit != pivot").filter(may_link("n", "pos", "pivot_n", "pivot_pos")).select(F.col("pivot").alias("a"), F.col("unit").alias("b"), (F.col("size") == 2).cast("long").alias("shared"))
    few = lists.filter(f"size between 3 and {short_list}")
    left, right = (few.select("t", F.col("unit").alias(u), F.col("n").alias(f"n{x}"), F.col("pos").alias(f"p{x}")) for u, x in (("a", 1), ("b", 2)))
    short = left.join(right.hint("merge"), "t").filter("a < b").filter(may_link("n1", "p1", "n2", "p2")).select("a", "b", F.lit(1).cast("long").alias("shared"))
    met = star.unionByName(short).groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    for side in "ab":
        met = met.join(facts.select(F.col("unit").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("n", "take", "long"))), side)
    first_pairs = session.stored(met.filter(enough_shared(percent, "shared")).select("a", "b"), "pairs")
    asked = first_pairs.select(F.col("a").alias("node")).unionByName(first_pairs.select(F.col("b").alias("node"))).distinct()
    written.append(sets := node_sets(staged, n, session.stored(asked, "asked"), k))
    known = session.stored(verified(first_pairs, sets), "verified")
    links = inside.filter(linked(percent)).select("a", "b").unionByName(known.filter(linked(percent)).select("a", "b"))
    classes = components(links)

    # Long lists: units in different classes, unless the distances to the list's first exclude a link.
    long = lists.filter(f"size > {short_list}").select("t", "unit", "pos", "pivot").join(classes.withColumnRenamed("node", "unit"), "unit", "left").withColumn("component", F.coalesce("component", "unit"))
    mixed = long.groupBy("t").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).filter("c1 != c2").select("t")
    distance = known.select(F.col("a").alias("pivot"), F.col("b").alias("unit"), jaccard_distance().alias("d"))
    long = session.stored(long.join(mixed.hint("merge"), "t", "left_semi").join(facts, "unit").join(distance, ["pivot", "unit"], "left").select("t", "unit", "n", "take", "long", "pos", "component", "d", "reach"), "long")
    tell = lambda x: long.select("t", *(F.col(c).alias(f"{c}_{x}") for c in ("unit", "n", "take", "long", "pos", "component", "d", "reach")))
    gap = 1 - percent / 100 + 1e-9
    # What they share on short lists has been counted: a pair not met there shares long lists only.
    late = tell("a").join(tell("b").hint("merge"), "t").filter("component_a < component_b").filter(may_link("n_a", "pos_a", "n_b", "pos_b")).filter(enough_shared(percent, "0")).filter(f"coalesce(abs(d_a - d_b) <= {gap} + reach_a + reach_b, true)")
    late = session.stored(late.select(F.least("unit_a", "unit_b").alias("a"), F.greatest("unit_a", "unit_b").alias("b")).distinct().join(first_pairs, ["a", "b"], "left_anti"), "late")
    if not late.isEmpty():
        asked = late.select(F.col("a").alias("node")).unionByName(late.select(F.col("b").alias("node"))).distinct()
        written.append(sets := node_sets(staged, n, session.stored(asked, "asked"), k))
    late_known = session.stored(verified(late, sets), "late-verified")
    links = links.unionByName(late_known.filter(linked(percent)).select("a", "b"))

    # Units near each other by their first nodes: their members may link though those don't.
    tested = known.unionByName(late_known).filter(~linked(percent)).withColumn("d", jaccard_distance())
    for side in "ab":
        tested = tested.join(reach.select(F.col("unit").alias(side), F.col("reach").alias(f"r{side}")), side, "left").fillna(0.0, [f"r{side}"])
    close = tested.filter(f"ra + rb > 0 and d <= {gap} + ra + rb").select("a", "b", "d")
    inner = inside.filter(linked(percent)).select(F.col("a").alias("unit"), F.col("b").alias("node"), jaccard_distance().alias("r"))
    inner = inner.unionByName(inner.select("unit", F.col("unit").alias("node"), F.lit(0.0).alias("r")).distinct())
    # Closer still: units already in one class by now need no more pairs.
    now = components(links)
    for side in "ab":
        close = close.join(now.select(F.col("node").alias(side), F.col("component").alias(f"c{side}")), side, "left")
    close = close.filter("coalesce(ca, a) != coalesce(cb, b)").select("a", "b", "d")
    one = close.join(inner.select(F.col("unit").alias("a"), F.col("node").alias("x"), F.col("r").alias("rx")), "a", "left").withColumn("x", F.coalesce("x", "a")).fillna(0.0, ["rx"])
    two = one.join(inner.select(F.col("unit").alias("b"), F.col("node").alias("y"), F.col("r").alias("ry")), "b", "left").withColumn("y", F.coalesce("y", "b")).fillna(0.0, ["ry"])
    more = session.stored(two.filter(f"d <= {gap} + rx + ry and not (x = a and y = b)").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "members-met")
    if not more.isEmpty():
        asked = more.select(F.col("a").alias("node")).unionByName(more.select(F.col("b").alias("node"))).distinct()
        written.append(sets := node_sets(staged, n, session.stored(asked, "asked"), k))
        now = components(links.unionByName(verified(more, sets).filter(linked(percent)).select("a", "b")))
    # What the result reads is small and stored; the rest goes.
    slim = session.stored(every.select("doc_id", "n", "d1", "d2"), "sizes")
    staging.discard(staged, every, *written)
    session.drop_since(spark, before, slim.path, nodes.path, now.path)
    result = slim.join(nodes.select("n", "d1", "d2", "node"), ["n", "d1", "d2"], "left").join(now, "node", "left")
    own = F.when(F.col("n") > 0, F.coalesce("component", "node"))
    return result.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(own, "doc_id").alias("component_id"))
