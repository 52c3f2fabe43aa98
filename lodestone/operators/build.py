"""From extraction records to graph tables. Order matters (first name, first provenance), so rows carry (row_ord, item_ord)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from lodestone.functions import text
from lodestone.operators.graph import PRACTICE


def entity_rows(extractions: DataFrame, thesaurus) -> DataFrame:
    """One row for each entity of a record, with its canonical name and node id."""
    rows = extractions.select("row_ord", "doc_id", "chunk_id", F.posexplode("entities").alias("item_ord", "e")).select("row_ord", "doc_id", "chunk_id", "item_ord", "e.*")
    return thesaurus.canonicalised(rows, "name", "canon").withColumn("id", text.node_id(F.col("type"), F.col("canon")))


def entities(rows: DataFrame, doc_geography: DataFrame, confidence: float = 0.9) -> DataFrame:
    """A node for each id: mentions, first provenance and name, attributes of first value, synonyms in order of appearance."""
    at = F.struct("row_ord", "item_ord")
    names = F.filter(F.transform(F.concat("synonyms", F.array("name")), lambda s: F.trim(s)), lambda s: s != "")
    # Synonyms are aggregated as distinct values with their first place, so a frequent entity has a row for each spelling, not each mention.
    spelled = rows.select("id", "row_ord", "item_ord", F.posexplode(names).alias("k", "s")).groupBy("id", "s").agg(F.min(F.struct("row_ord", "item_ord", "k")).alias("first"))
    spelled = spelled.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "s"))), lambda x: x["s"]).alias("synonyms"))
    given = rows.select("id", "row_ord", "item_ord", F.explode("attrs").alias("k", "v")).groupBy("id", "k").agg(F.min_by("v", at).alias("v"))
    given = given.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("attrs"))
    base = rows.groupBy("id").agg(F.min_by(F.struct("type", "canon", "doc_id", "chunk_id"), at).alias("f"), F.count(F.lit(1)).alias("n_mentions"))
    out = base.join(spelled, "id", "left").join(given, "id", "left").join(majority_geography(rows, doc_geography), "id", "left")
    synonyms = F.coalesce("synonyms", F.array().cast("array<string>"))
    return out.select("id", "f.type", F.col("f.canon").alias("name"), text.other_script_name(F.col("f.canon"), synonyms).alias("name_en"), F.coalesce("geography", F.lit("unknown")).alias("geography"), "n_mentions", "f.doc_id", "f.chunk_id", F.lit(confidence).alias("confidence"), synonyms.alias("synonyms"), "attrs")


def majority_geography(rows: DataFrame, doc_geography: DataFrame) -> DataFrame:
    """(id, geography): that of most documents of a node; unknown on a tie. Documents without one count as unknown."""
    docs = rows.select("id", "doc_id").distinct().join(doc_geography.select("doc_id", "geography"), "doc_id", "left")
    counts = docs.groupBy("id", F.coalesce("geography", F.lit("unknown")).alias("geography")).count()
    best = counts.groupBy("id").agg(F.max("count").alias("most"))
    top = counts.join(best, "id").filter("count = most").groupBy("id").agg(F.count(F.lit(1)).alias("ties"), F.min("geography").alias("g"))
    return top.select("id", F.when(F.col("ties") > 1, "unknown").otherwise(F.col("g")).alias("geography"))


def endpoints(rows: DataFrame) -> DataFrame:
    """(chunk of a record, name) to its node: the first entity of that name; ``n`` different ones mean ambiguity."""
    return rows.groupBy("row_ord", F.lower(F.trim("name")).alias("key")).agg(F.min_by("id", "item_ord").alias("node"), F.countDistinct("id").alias("n"))


def relation_rows(extractions: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Resolved relations; those with a missing end (GRAPH-004); ends that several entities answer to (GRAPH-005)."""
    said = extractions.select("row_ord", "doc_id", "chunk_id", F.posexplode("relations").alias("item_ord", "r")).select("row_ord", "doc_id", "chunk_id", "item_ord", "r.*")
    known = endpoints(rows)
    for end in ("source", "target"):
        side = known.select("row_ord", F.col("key").alias("k"), F.col("node").alias(f"{end}_id"), F.col("n").alias(f"{end}_n"))
        said = said.withColumn("k", F.lower(F.trim(end))).join(side, ["row_ord", "k"], "left").drop("k")
    missing = said.filter("source_id is null or target_id is null").select("doc_id", "chunk_id", "source", "target", "type", F.lit("GRAPH-004").alias("code"))
    ends = lambda e: said.filter(f"{e}_n > 1").select("doc_id", "chunk_id", F.col(e).alias("name"), F.col(f"{e}_id").alias("node"), F.lit("GRAPH-005").alias("code"))
    return said.filter("source_id is not null and target_id is not null"), missing, ends("source").unionByName(ends("target"))


def relations(rows: DataFrame) -> DataFrame:
    """A row for each (source, target, type): evidence, best confidence, first provenance, constraints distinct by content."""
    keys = ["source_id", "target_id", "type"]
    content = ["c.param", "c.op", "c.value", "c.value_max", "c.unit"]
    base = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_evidence"), F.max("confidence").alias("confidence"), F.min_by(F.struct("doc_id", "chunk_id"), F.struct("row_ord", "item_ord")).alias("f"))
    first = rows.select(*keys, "row_ord", "item_ord", F.posexplode("constraints").alias("k", "c")).withColumn("n", F.row_number().over(W.partitionBy(*keys, *content).orderBy("row_ord", "item_ord", "k"))).filter("n = 1")
    lists = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("row_ord", "item_ord", "k", "c"))), lambda x: x["c"]).alias("constraints"))
    return base.join(lists, keys, "left").select(*keys, "confidence", "n_evidence", "f.doc_id", "f.chunk_id", "constraints")


def with_solutions(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Processes that are the source of a practice relation are technical solutions."""
    sources = links.filter(F.col("type").isin(*PRACTICE)).select(F.col("source_id").alias("id"), F.lit(True).alias("solves")).distinct()
    return nodes.join(sources, "id", "left").withColumn("is_tech_solution", F.coalesce("solves", F.lit(False)) & (F.col("type") == "Process")).drop("solves")


def constraint_rows(extractions: DataFrame) -> DataFrame:
    """Constraints of records with their ids; ``ord`` tells the later of two equal ones."""
    rows = extractions.select("row_ord", "chunk_id", F.posexplode("constraints").alias("item_ord", "c")).select("row_ord", "item_ord", "chunk_id", "c.*")
    plain = lambda c: F.coalesce(F.regexp_replace(F.format_string("%.6f", F.col(c)), r"(\.\d+?)0+$", "$1"), F.lit("None"))
    key = F.concat_ws("|", "chunk_id", "param", "op", plain("value"), plain("value_max"), "unit")
    return rows.withColumn("id", text.short_sha1(key)).withColumn("ord", F.struct("row_ord", "item_ord"))


def merged_in_chunk(extractions: DataFrame, thesaurus) -> DataFrame:
    """Entities of a record merged by canonical name: first type, all synonyms, the last value of an attribute."""
    rows = extractions.select("row_ord", "chunk_id", F.posexplode("entities").alias("item_ord", "e")).select("row_ord", "chunk_id", "item_ord", "e.*")
    rows = thesaurus.canonicalised(rows, "name", "canon")
    base = rows.groupBy("row_ord", "chunk_id", "canon").agg(F.min("item_ord").alias("ord"), F.min_by("type", "item_ord").alias("type"))
    said = rows.select("row_ord", "canon", "item_ord", F.posexplode(F.concat("synonyms", F.when(F.col("name") != F.col("canon"), F.array("name")).otherwise(F.array().cast("array<string>")))).alias("k", "s")).groupBy("row_ord", "canon", "s").agg(F.min(F.struct("item_ord", "k")).alias("first"))
    said = said.groupBy("row_ord", "canon").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "s"))), lambda x: x["s"]).alias("synonyms"))
    given = rows.select("row_ord", "canon", "item_ord", F.explode("attrs").alias("k", "v")).groupBy("row_ord", "canon", "k").agg(F.max_by("v", "item_ord").alias("v"))
    given = given.groupBy("row_ord", "canon").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("attrs"))
    return base.join(said, ["row_ord", "canon"], "left").join(given, ["row_ord", "canon"], "left").select("row_ord", "chunk_id", "ord", F.col("canon").alias("name"), "type", "synonyms", "attrs")


def marked_relations(extractions: DataFrame, thesaurus, names: DataFrame | None = None) -> DataFrame:
    """Relations with canonical ends and ``kept``: whether both are among the record's entities; ``names`` (row_ord, name): those entities, where they aren't the records' own."""
    names = extractions.select("row_ord", F.explode("entities.name").alias("name")) if names is None else names
    names = thesaurus.canonicalised(names.withColumn("name", F.trim("name")), "name", "canon").select("row_ord", "canon").distinct()
    said = extractions.select("row_ord", "doc_id", "chunk_id", F.explode("relations").alias("r")).select("row_ord", "doc_id", "chunk_id", "r.*")
    for end in ("source", "target"):
        said = thesaurus.canonicalised(said.withColumn(end, F.trim(end)), end, f"{end}_canon").withColumn(end, F.col(f"{end}_canon")).drop(f"{end}_canon")
        said = said.join(names.select("row_ord", F.col("canon").alias(end), F.lit(True).alias(f"{end}_known")), ["row_ord", end], "left")
    return said.withColumn("kept", F.coalesce("source_known", F.lit(False)) & F.coalesce("target_known", F.lit(False))).drop("source_known", "target_known")


def kept_relations(extractions: DataFrame, thesaurus) -> tuple[DataFrame, DataFrame]:
    """Relations with canonical ends that are both among the record's entities, and the dropped ones (EXTRACT-003)."""
    said = marked_relations(extractions, thesaurus)
    return said.filter("kept").drop("kept"), said.filter(~F.col("kept")).select("doc_id", "chunk_id", "source", "target", "type", F.lit("EXTRACT-003").alias("code"))
