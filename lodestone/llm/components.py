"""Connected components of a link table by repeated small-star and large-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestone import session


def digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(links: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node that each linked node reaches, from links (a, b).

    Every round points nodes at smaller ones and is written to the shared folder; a
    neighbourhood is only ever aggregated, never collected. Links with a null end and
    self-links say nothing; no links give no rows.
    """
    edges = session.stored(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = digest(edges)
    for _ in range(max_rounds):
        # Large star: every larger neighbour of a node goes to the least of its neighbourhood.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: what a node and its smaller neighbours share is the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        # Links only get fewer, so as many files as the last round's number needs will do.
        before, path = mark, edges.path
        edges = session.stored(small.coalesce(1 + before[0] // 500_000), "links")
        session.drop_path(edges.sparkSession, path)
        mark = digest(edges)
        if mark == before:
            break
    else:
        raise RuntimeError("the components did not settle")
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    found.path = edges.path
    return found
