"""Upserts as joins: the table after a merge is a new DataFrame, written beside the old one and swapped in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestone import session


def one_per_key(rows: DataFrame, keys: Sequence[str], ord_col: str | None = None, last: bool = True) -> DataFrame:
    """The last (or first) row of each key by ``ord_col``; without an order the greatest row, so that the result is fixed."""
    rest = [c for c in rows.columns if c not in keys]
    # Maps have no order of their own; their text has.
    orderable = [F.to_json(c) if "map<" in kind else F.col(c) for c, kind in rows.dtypes if c in rest]
    by = F.struct(*([ord_col] if ord_col else []), *orderable)
    picked = rows.groupBy(*keys).agg((F.max_by if last else F.min_by)(F.struct(*rest), by).alias("r"))
    return picked.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest if c != ord_col))


def merge(old: DataFrame, new: DataFrame, keys: Sequence[str], rules: dict[str, str], ord_col: str | None = None) -> DataFrame:
    """Full outer merge by key. Rules: new (overwrite), keep (first stays), max, or, coalesce (new unless null).

    Of new rows with one key the last by ``ord_col`` counts (without an order the greatest);
    what only grows takes the most of all of them. Grouping and joining share one exchange.
    """
    grows = {c: {"max": F.max, "or": F.bool_or}[r] for c, r in rules.items() if r in ("max", "or") and c in new.columns}
    picked = one_per_key(new, keys, ord_col)
    if grows:
        picked = picked.drop(*grows).join(new.groupBy(*keys).agg(*(f(c).alias(c) for c, f in grows.items())), list(keys))
    new = picked
    both = old.withColumn("__old", F.lit(True)).alias("o").join(new.withColumn("__new", F.lit(True)).alias("n"), list(keys), "full_outer")

    def value(c: str) -> Column:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        added, kept = F.col("__old").isNull(), F.col("__new").isNull()
        by_rule = {"new": b, "keep": a, "max": F.greatest(a, b), "or": F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), "coalesce": F.coalesce(b, a)}[rules.get(c, "new")]
        return F.when(added, b).when(kept, a).otherwise(by_rule).alias(c)

    return both.select(*keys, *(value(c) for c in old.columns if c not in keys))


def upsert_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    return merge(old, new.select(*old.columns), ["doc_id"], {})


def upsert_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """All fields of the new chunk, but a vector is kept where the new one is null; chunks need no document."""
    return merge(old, new, ["chunk_id"], {"embedding": "coalesce"})


def upsert_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """Mentions and confidence only grow, a technical solution stays one; everything else keeps its first value."""
    return merge(old, new, ["id"], {c: "keep" for c in old.columns} | {"n_mentions": "max", "confidence": "max", "is_tech_solution": "or"})


def upsert_relations(old: DataFrame, new: DataFrame, entities: DataFrame) -> DataFrame:
    """As entities; a relation whose end is missing is left out."""
    for end in ("source_id", "target_id"):
        new = new.join(entities.select(F.col("id").alias(end)), end, "left_semi")
    keys = ["source_id", "target_id", "type"]
    return merge(old, new.select(*old.columns), keys, {c: "keep" for c in old.columns} | {"n_evidence": "max", "confidence": "max"})


def upsert_constraints(old: DataFrame, new: DataFrame, chunks: DataFrame, ord_col: str | None = None) -> DataFrame:
    """The last row of an id wins; constraints of missing chunks are left out."""
    kept = one_per_key(new.join(chunks.select("chunk_id"), "chunk_id", "left_semi"), ["id"], ord_col)
    return merge(old, kept.select(*old.columns), ["id"], {})


def upsert_mentions(old: DataFrame, new: DataFrame, entities: DataFrame, chunks: DataFrame) -> DataFrame:
    real = new.join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    return old.unionByName(real.select(*old.columns)).distinct()


def update_geography(documents: DataFrame, new: DataFrame) -> DataFrame:
    """Known geographies replace a document's; unknown ones don't, and documents that don't exist aren't made."""
    allowed = ("ru", "foreign", "global", "unknown")
    valid = new.withColumn("geography", F.when(F.col("geography").isin(*allowed), F.col("geography")).otherwise(F.raise_error(F.concat(F.lit("GRAPH-006: geography "), F.coalesce("geography", F.lit("null"))))))
    known = one_per_key(valid.filter("geography != 'unknown'").select("doc_id", F.col("geography").alias("found")), ["doc_id"])
    return documents.join(known, "doc_id", "left").withColumn("geography", F.coalesce("found", "geography")).select(*documents.columns)


def pending(rows: DataFrame, done: DataFrame, key: str, targets: DataFrame | None = None, target_key: str = "doc_id") -> DataFrame:
    """Rows of the targets that no earlier run has done."""
    if targets is not None:
        rows = rows.join(targets.select(target_key).distinct(), target_key, "left_semi")
    return rows.join(done.select(key).distinct(), key, "left_anti")


def split_failed(rows: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Good rows without the error struct, and rejected ones with its code and reason."""
    keys = [c for c in ("doc_id", "chunk_id", "path") if c in rows.columns]
    return rows.filter(F.col(error).isNull()).drop(error), rows.filter(F.col(error).isNotNull()).select(*keys, f"{error}.code", f"{error}.reason")


def swap_in(df: DataFrame, path: str) -> None:
    """Write beside ``path`` and rename: what is read from ``path`` may be part of ``df``.

    The old table is moved aside before the new one is moved in and deleted after that, so at
    any moment a whole table is at ``path`` or at ``path.old``; ``recovered`` puts one back.
    """
    spark: SparkSession = df.sparkSession
    recovered(spark, path)
    df.write.mode("overwrite").parquet(f"{path}.new")
    if session.exists(spark, path):
        session.move(spark, path, f"{path}.old")
    session.move(spark, f"{path}.new", path)
    session.drop_path(spark, f"{path}.old")
    spark.catalog.refreshByPath(path)


def recovered(spark: SparkSession, path: str) -> None:
    """After a swap that broke off: the old table back in its place, or gone where the new one is."""
    if session.exists(spark, f"{path}.old"):
        if session.exists(spark, path):
            session.drop_path(spark, f"{path}.old")
        else:
            session.move(spark, f"{path}.old", path)


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that break uniqueness."""
    return rows.groupBy(*keys).count().filter("count > 1")


def counters(entities: DataFrame, relations: DataFrame, types: Sequence[str], relation_types: Sequence[str]) -> DataFrame:
    """(what, kind, n): entities by type and relations by type, zeros included."""
    spark = entities.sparkSession
    every = spark.createDataFrame([("entity", t) for t in types] + [("relation", t) for t in relation_types], "what string, kind string")
    found = entities.groupBy(F.col("type").alias("kind")).count().withColumn("what", F.lit("entity")).unionByName(relations.groupBy(F.col("type").alias("kind")).count().withColumn("what", F.lit("relation")))
    return every.join(found, ["what", "kind"], "left").select("what", "kind", F.coalesce("count", F.lit(0)).alias("n"))
