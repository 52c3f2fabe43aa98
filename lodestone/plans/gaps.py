"""The gap report and recommendations."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestone import session
from lodestone.operators import vector
from lodestone.operators.graph import GraphTables
from lodestone.plans import templates


def _tier(first: Sequence[tuple[str, str]], material_topics: Sequence[str], process_topics: Sequence[str]) -> Column:
    m, p = F.lower(F.trim("material_name")), F.lower(F.trim("process_name"))
    critical = F.lit(False)
    for a, b in first:
        critical = critical | ((m == a) & (p == b))
    return F.when(critical, 0).when(m.isin(*material_topics) & p.isin(*process_topics), 1).otherwise(2) if material_topics and process_topics else F.when(critical, 0).otherwise(2)


def _order(tier: Column) -> list:
    return [F.col("n_sources").asc(), tier.asc(), (F.col("material_n_mentions") + F.col("process_n_mentions")).desc(), F.col("material_name").asc(), F.col("process_name").asc(), F.col("material_id").asc(), F.col("process_id").asc()]


def ordered_cells(pairs: DataFrame, first: Sequence[tuple[str, str]] = (), material_topics: Sequence[str] = (), process_topics: Sequence[str] = ()) -> tuple[DataFrame, list]:
    """Pairs with their tier, and the order of the report: few sources, tier, many mentions, names."""
    return pairs.withColumn("tier", _tier(first, material_topics, process_topics)), _order(F.col("tier"))


def first_cells(g: GraphTables, material_terms: Sequence[str], process_terms: Sequence[str], limit: int | None = None, per_material: int | None = None, first: Sequence[tuple[str, str]] = (), material_topics: Sequence[str] = (), process_topics: Sequence[str] = ()) -> tuple[DataFrame, list]:
    """As ``ordered_cells`` of the whole matrix, but only cells among which are the first ``per_material`` of each material, or else the first ``limit``."""
    p = F.lower(F.trim("process_name"))
    # A material's gaps have one tier with all processes of a kind: those of one name that is asked for first, topics or not.
    kind = F.concat_ws("|", F.coalesce(p.isin(*process_topics), F.lit(False)).cast("string"), F.when(p.isin(*sorted({b for _, b in first})), p))
    by_mentions = [F.desc("process_n_mentions"), F.asc("process_name"), F.asc("process_id")]
    rows = templates.first_gaps(g, *templates.gap_lists(g, material_terms, process_terms), _order(_tier(first, material_topics, process_topics)), by_mentions, limit, per_material, kind)
    return ordered_cells(rows, first, material_topics, process_topics)


def cap_per_material(rows: DataFrame, order: list, most: int = 3) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(W.partitionBy("material_name").orderBy(*order))).filter(F.col("place") <= most)


def conditions(g: GraphTables, cells: DataFrame, most: int = 2) -> DataFrame:
    """(material_id, process_id, condition): the first distinct conditions of a cell's chunks, a chunk giving its first constraint or else property."""
    chunks = cells.select("material_id", "process_id", F.posexplode("chunk_ids").alias("ord", "chunk_id"))
    context = templates.gap_cell_context(g, chunks.select("chunk_id"))
    text = context.select("chunk_id", F.get(F.filter(F.transform(F.concat("constraint_texts", "property_names"), lambda t: F.trim(t)), lambda t: t != ""), 0).alias("text")).filter("text is not null")
    found = chunks.join(text, "chunk_id").groupBy("material_id", "process_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("t"))
    return found.select("material_id", "process_id", F.array_join(F.slice(F.array_distinct(F.transform("t", lambda x: x["text"])), 1, most), "; ").alias("condition"))


def gap_cells(g: GraphTables, material_terms: Sequence[str], process_terms: Sequence[str], limit: int = 50, per_material: int = 3, **topics) -> DataFrame:
    if limit < 0:
        raise ValueError(f"ANALYTICS-002: a limit of {limit}")
    rows, order = first_cells(g, material_terms, process_terms, per_material=per_material, **topics)
    # At most ``limit`` rows, read twice below: the pairs are made once.
    cells = session.stored(cap_per_material(rows, order, per_material).orderBy(*order).limit(limit), "cells")
    out = cells.join(conditions(g, cells), ["material_id", "process_id"], "left")
    return out.select(F.col("material_name").alias("material"), F.col("process_name").alias("process"), F.coalesce("condition", F.lit("")).alias("condition"), F.col("n_sources").cast("long").alias("n_sources"), "material_id", "process_id")


def only_here(themes: DataFrame) -> DataFrame:
    """(name, side): themes whose documents' geographies are exactly one of the two sides."""
    side = F.when(F.col("doc_geographies") == F.array(F.lit("ru")), "ru").when(F.col("doc_geographies") == F.array(F.lit("foreign")), "foreign")
    return themes.select("node_id", "name", side.alias("side")).filter("side is not null")


def adjacent_topics(candidates: DataFrame, top_k: int = 3, preferred: Sequence[str] = ("Material", "Process", "Property")) -> DataFrame:
    """The best row of each neighbour, preferred types and many mentions first."""
    best = candidates.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy(F.desc("n_mentions"), "via_id"))).filter("n = 1").drop("n")
    return best.orderBy(F.col("type").isin(*preferred).desc(), F.desc("n_mentions"), "id").limit(top_k)


def expert_key(title):
    """Lower-cased parts of a name without dots, in order, so that their order doesn't count."""
    return F.array_join(F.array_sort(F.filter(F.split(F.lower(F.regexp_replace(title, r"\.", " ")), r"(?U)\s+"), lambda x: x != "")), " ")


def distinct_experts(items: DataFrame) -> DataFrame:
    """The first item (least ``ord``) of each expert."""
    return items.withColumn("n", F.row_number().over(W.partitionBy(expert_key(F.col("title"))).orderBy("ord"))).filter("n = 1").drop("n")


#: The kinds of recommendations in the order in which they are shown.
KINDS = ("similar_case", "expert", "adjacent_topic")
RECOMMENDATION = "kind string, place int, id string, title string, reason string, score double"


def _tolerant(spark, code: str, branch: Callable[[], DataFrame]) -> DataFrame:
    """What a branch gives, worked out here so that its failure is known; a failed branch gives nothing and leaves a line in the log."""
    try:
        return session.stored(branch(), "recommended")
    except Exception as error:
        logging.getLogger("lodestone").warning(json.dumps({"event": code, "detail": str(error)[:500]}, ensure_ascii=False))
        return spark.createDataFrame([], RECOMMENDATION)


def recommendations(g: GraphTables, question: Sequence[float] | Callable[[], Sequence[float]] | None, cited: DataFrame, node_ids: DataFrame, top_k: int = 3, pool: int = 40) -> DataFrame:
    """(kind, place, id, title, reason, score): up to ``top_k`` of each kind for an answer that cites ``cited`` (chunk_id, doc_id).

    Similar cases are the best chunks of documents that aren't cited among the ``pool`` nearest
    (ANALYTICS-003 where the vector side fails), experts are told apart by the parts of their
    names, adjacent topics are neighbours of ``node_ids`` (ANALYTICS-004 where a query fails).
    One kind's failure leaves the others.
    """
    spark = cited.sparkSession
    if top_k < 0:
        raise ValueError(f"ANALYTICS-002: a limit of {top_k}")

    def of(rows: DataFrame, kind: str, order: list, key: str, title: str, reason: str, score: str) -> DataFrame:
        place = F.row_number().over(W.orderBy(*order))  # over top_k rows
        return rows.select(F.lit(kind).alias("kind"), place.alias("place"), F.col(key).cast("string").alias("id"), F.col(title).alias("title"), F.col(reason).cast("string").alias("reason"), F.col(score).cast("double").alias("score"))

    def similar() -> DataFrame:
        asked = question() if callable(question) else question
        if asked is None:
            raise ValueError("no vector of the question")
        hits = vector.vector_search(g.chunks, asked, pool).select("chunk_id", "doc_id", "score")
        best = vector.best_per_document(hits, cited, top_k).join(g.documents.select("doc_id", "title", "year"), "doc_id", "left")
        return of(best, KINDS[0], [F.desc("score"), "chunk_id"], "doc_id", "title", "chunk_id", "score")

    def experts() -> DataFrame:
        # Twice as many, for names that turn out to be one person's.
        found = templates.recommendation_expert(g, cited.select("chunk_id"), cited.select("doc_id"), node_ids, 2 * top_k)
        order = [F.desc("n_matched_sources"), F.desc("n_mentions"), "id"]
        found = distinct_experts(found.withColumn("title", F.col("name")).withColumn("ord", F.row_number().over(W.orderBy(*order)))).orderBy("ord").limit(top_k)
        return of(found, KINDS[1], ["ord"], "id", "name", "n_matched_sources", "n_mentions")

    def adjacent() -> DataFrame:
        found = adjacent_topics(templates.recommendation_adjacent(g, node_ids), top_k).withColumn("preferred", F.col("type").isin("Material", "Process", "Property"))
        return of(found, KINDS[2], [F.desc("preferred"), F.desc("n_mentions"), "id"], "id", "name", "via_name", "n_mentions")

    return _tolerant(spark, "ANALYTICS-003", similar).unionByName(_tolerant(spark, "ANALYTICS-004", experts)).unionByName(_tolerant(spark, "ANALYTICS-004", adjacent))


def grouped(items: DataFrame) -> DataFrame:
    """(kind, items): recommendations by kind in the fixed order; kinds without any don't occur, unknown kinds come last."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.lit(0)), F.lit(len(KINDS) + 1))
    found = items.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("place", "id", "title", "reason", "score"))).alias("items"))
    return found.orderBy(rank, "kind")
