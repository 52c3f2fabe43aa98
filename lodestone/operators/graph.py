"""Graph tables and the joins that graph patterns stand for."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Relation types, as stored.
USES, OPERATES, PRODUCES, DESCRIBED, VALIDATED, CONTRADICTS = RELATION_TYPES = ("USES_MATERIAL", "OPERATES_AT_CONDITION", "PRODUCES_OUTPUT", "DESCRIBED_IN", "VALIDATED_BY", "CONTRADICTS")
#: Relations that make their Process a technical solution, and that fill a gap.
PRACTICE = (USES, OPERATES, PRODUCES)
#: Entity types.
ENTITY_TYPES = ("Material", "Process", "Equipment", "Property", "Experiment", "Publication", "Expert", "Facility")


@dataclass(frozen=True)
class GraphTables:
    """documents(doc_id, title, year, geography), chunks(chunk_id, doc_id, ...), entities(id, type, name, name_en,
    geography, is_tech_solution, confidence, n_mentions), relations(source_id, target_id, type, confidence, n_evidence,
    doc_id, chunk_id), mentions(entity_id, chunk_id; pairs may repeat, and a third column may tell the entity's type),
    constraints(id, chunk_id, param, op, norm_value, value_max, norm_unit, source_text)."""

    documents: DataFrame
    chunks: DataFrame
    entities: DataFrame
    relations: DataFrame
    mentions: DataFrame
    constraints: DataFrame

    def of_type(self, *types: str) -> DataFrame:
        return self.entities.filter(F.col("type").isin(*types))

    def mentions_of(self, *types: str) -> DataFrame:
        """Mentions of entities of some types; where mentions tell the type, no entity is read."""
        if "type" in self.mentions.columns:
            return self.mentions.filter(F.col("type").isin(*types)).select("entity_id", "chunk_id")
        return self.mentions.join(self.of_type(*types).select(F.col("id").alias("entity_id")).distinct(), "entity_id", "left_semi")


def contains_any(terms: Sequence[str], *columns: str) -> Column:
    """Whether a lower-cased column contains one of the terms; no terms: false; null columns: as empty text."""
    out = F.lit(False)
    for c in columns:
        for t in terms:
            out = out | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(t)
    return out


def named(entities: DataFrame, terms: Sequence[str]) -> DataFrame:
    return entities.filter(contains_any(terms, "name", "name_en"))


def year_from(column: str, year: int | None) -> Column:
    """No bound, or no year, or the year reaches the bound."""
    return F.lit(True) if year is None else F.col(column).isNull() | (F.col(column) >= year)


def neighbours(relations: DataFrame, types: Sequence[str], around: DataFrame | None = None) -> DataFrame:
    """(a, b) in both directions, distinct; ``around`` (column id): only those with a among its ids, cut down before anything is doubled."""
    there = relations.filter(F.col("type").isin(*types)).select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).distinct()
    back = there.select(F.col("b").alias("a"), F.col("a").alias("b"))
    if around is not None:
        ids = around.select(F.col("id").alias("a")).distinct()
        there, back = there.join(ids, "a", "left_semi"), back.join(ids, "a", "left_semi")
    return there.unionByName(back).distinct()


def mentioned(mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mentions of the nodes (column id)."""
    return mentions.join(nodes.select(F.col("id").alias("entity_id")).distinct(), "entity_id", "left_semi").select("entity_id", "chunk_id")


def co_mentions(left_mentions: DataFrame, left: DataFrame, right: DataFrame, right_mentions: DataFrame | None = None) -> DataFrame:
    """(a, b, chunk_id), distinct: ids of ``left`` and ``right`` (column id) mentioned in the same chunk; each side is cut
    down before they meet. ``right_mentions``: where the right side's mentions are another table, as those of one type."""
    a = mentioned(left_mentions, left).distinct()
    b = mentioned(left_mentions if right_mentions is None else right_mentions, right).distinct()
    return a.select(F.col("entity_id").alias("a"), "chunk_id").join(b.select(F.col("entity_id").alias("b"), "chunk_id"), "chunk_id").select("a", "b", "chunk_id")


def set_of(column: str | Column, name: str) -> Column:
    """Distinct values without null, in order."""
    return F.array_sort(F.collect_set(column)).alias(name)


def or_empty(name: str, kind: str = "array<string>") -> Column:
    return F.coalesce(F.col(name), F.array().cast(kind)).alias(name)


def _of(g: GraphTables, nodes: DataFrame, types: Sequence[str]) -> DataFrame:
    """Mentions of nodes, read from those of the types that they can be of (none: any)."""
    return mentioned(g.mentions_of(*types) if types else g.mentions, nodes)


def chunk_sets(g: GraphTables, nodes: DataFrame, *types: str) -> DataFrame:
    """(id, chunk_ids) of the nodes that are mentioned; ``types``, here and below: those of the nodes."""
    return _of(g, nodes, types).groupBy(F.col("entity_id").alias("id")).agg(set_of("chunk_id", "chunk_ids"))


def constraint_sets(g: GraphTables, nodes: DataFrame, param_terms: Sequence[str], *types: str) -> DataFrame:
    """(id, constraints): those in the nodes' chunks; with terms, the list is trimmed to parameters that contain one, and rows stay."""
    mine = _of(g, nodes, types)
    fields = ("param", "norm_value", "value_max", "norm_unit", "source_text")
    found = mine.join(g.constraints, "chunk_id").select(F.col("entity_id").alias("id"), F.struct(*fields).alias("c")).distinct()
    found = found.groupBy("id").agg(F.array_sort(F.collect_list("c")).alias("constraints"))
    if param_terms:
        keep = lambda x: F.exists(F.array(*(F.lit(t) for t in param_terms)), lambda t: F.contains(F.lower(x["param"]), t))
        found = found.withColumn("constraints", F.filter("constraints", keep))
    return found


def document_sets(g: GraphTables, nodes: DataFrame, *types: str) -> DataFrame:
    """(id, doc_ids, doc_geographies) of the documents that mention the nodes."""
    mine = _of(g, nodes, types)
    found = mine.join(g.chunks.select("chunk_id", "doc_id"), "chunk_id").join(g.documents.select("doc_id", "geography"), "doc_id")
    return found.groupBy(F.col("entity_id").alias("id")).agg(set_of("doc_id", "doc_ids"), set_of("geography", "doc_geographies"))


def document_counts(g: GraphTables, nodes: DataFrame, *types: str) -> DataFrame:
    """(id, n_docs, doc_geographies) as ``document_sets`` gives them, counted: a node's documents are never held at once."""
    places = g.documents.select("doc_id", "geography").distinct().groupBy("doc_id").agg(set_of("geography", "g"))
    pairs = _of(g, nodes, types).join(g.chunks.select("chunk_id", "doc_id"), "chunk_id").select("entity_id", "doc_id").distinct()
    found = pairs.join(places, "doc_id").groupBy("entity_id", "g").agg(F.count(F.lit(1)).alias("n"))
    return found.groupBy(F.col("entity_id").alias("id")).agg(F.sum("n").alias("n_docs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("g")))).alias("doc_geographies"))
