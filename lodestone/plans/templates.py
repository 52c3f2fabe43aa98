"""The parametrised graph queries. Nodes are ranked and limited by their own columns first; then each set of collected
values is aggregated by node on its own and joined back, so no branch multiplies another and only the rows that are
returned collect anything. Every limit has a total order."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestone import session
from lodestone.operators.graph import (
    CONTRADICTS,
    PRACTICE,
    RELATION_TYPES,
    GraphTables,
    chunk_sets,
    co_mentions,
    constraint_sets,
    document_sets,
    mentioned,
    named,
    neighbours,
    or_empty,
    set_of,
    year_from,
)

CONSTRAINT = "array<struct<param:string,norm_value:double,value_max:double,norm_unit:string,source_text:string>>"
NODE = ("name", "name_en", "geography", "is_tech_solution", "confidence", "n_mentions")


def _ranked(rows: DataFrame, down: Sequence[str], limit: int | None, *ties: str) -> DataFrame:
    """The first rows in an order; no limit: all of them, in none."""
    return rows if limit is None else rows.orderBy(*(F.col(c).desc_nulls_last() for c in down), *ties).limit(limit)


def _once(rows: DataFrame, limit: int | None) -> DataFrame:
    """At most ``limit`` rows that several sets are collected for are made once; without a limit nothing is written."""
    return rows if limit is None else session.stored(rows, "ranked")


def desalination_methods(g: GraphTables, process_terms: Sequence[str], param_terms: Sequence[str] = (), limit: int | None = 30) -> DataFrame:
    """Processes by name with what they relate to (all types but contradictions), constraints and chunks."""
    p = _once(_ranked(named(g.of_type("Process"), process_terms), ("is_tech_solution", "confidence", "n_mentions"), limit, "id"), limit)
    related = neighbours(g.relations, [t for t in RELATION_TYPES if t != CONTRADICTS], p).join(g.entities.select(F.col("id").alias("b"), F.col("name").alias("b_name")), "b")
    related = related.groupBy(F.col("a").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("b").alias("id"), F.col("b_name").alias("name")))).alias("related"))
    out = p.join(related, "id", "left").join(constraint_sets(g, p, param_terms, "Process"), "id", "left").join(chunk_sets(g, p, "Process"), "id", "left")
    out = out.select(F.col("id").alias("node_id"), *NODE, or_empty("related", "array<struct<id:string,name:string>>"), or_empty("constraints", CONSTRAINT), or_empty("chunk_ids"))
    out = out.withColumn("node_ids", F.concat(F.array("node_id"), F.transform("related", lambda x: x["id"])))
    return _ranked(out, ("is_tech_solution", "confidence", "n_mentions"), limit, "node_id")


def catholyte_circulation(g: GraphTables, material_terms: Sequence[str], param_terms: Sequence[str] = (), limit: int | None = 30) -> DataFrame:
    """A row for each material found and process that practises it; constraints and chunks are the process's."""
    m = named(g.of_type("Material"), material_terms).select(F.col("id").alias("material_id"), F.col("name").alias("material_name"))
    pairs = neighbours(g.relations, PRACTICE, m.select(F.col("material_id").alias("id"))).join(m.withColumn("a", F.col("material_id")), "a")
    rows = pairs.withColumnRenamed("b", "id").drop("a").join(g.of_type("Process"), "id")
    rows = _once(_ranked(rows, ("is_tech_solution", "confidence", "n_mentions"), limit, "id", "material_id"), limit)
    p = rows.select("id").distinct()
    out = rows.join(constraint_sets(g, p, param_terms, "Process"), "id", "left").join(chunk_sets(g, p, "Process"), "id", "left")
    out = out.select(F.col("id").alias("node_id"), *NODE, "material_id", "material_name", or_empty("constraints", CONSTRAINT), or_empty("chunk_ids"), F.array("id", "material_id").alias("node_ids"))
    return _ranked(out, ("is_tech_solution", "confidence", "n_mentions"), limit, "node_id", "material_id")


TOPICAL = ("Experiment", "Publication")


def _by_topic(g: GraphTables, materials: DataFrame, year: int | None, limit: int | None) -> tuple[DataFrame, DataFrame]:
    """Chunks that mention a material found and whose year fits, and the experiments and publications in them."""
    chunks = mentioned(g.mentions_of("Material"), materials).select("chunk_id").distinct()
    if year is not None:
        chunks = chunks.join(g.chunks.select("chunk_id", "doc_id"), "chunk_id", "left").join(g.documents.select("doc_id", "year"), "doc_id", "left").filter(year_from("year", year)).select("chunk_id").distinct()
    ids = g.mentions_of(*TOPICAL).join(chunks, "chunk_id", "left_semi").select(F.col("entity_id").alias("id")).distinct()
    return chunks, _ranked(g.of_type(*TOPICAL).join(ids, "id", "left_semi"), ("confidence", "n_mentions"), limit, "id")


def experiments_publications_by_topic(g: GraphTables, material_terms: Sequence[str], year: int | None = None, limit: int | None = 30) -> DataFrame:
    """Experiments and publications that share a chunk with a material found."""
    m = named(g.of_type("Material"), material_terms)
    e = _once(_by_topic(g, m, year, limit)[1], limit)
    met = co_mentions(g.mentions_of("Material"), m, e, g.mentions_of(*TOPICAL)).join(m.select(F.col("id").alias("a"), F.col("name").alias("material")), "a")
    met = met.join(g.chunks.select("chunk_id", "doc_id"), "chunk_id", "left").join(g.documents.select("doc_id", "year"), "doc_id", "left").filter(year_from("year", year))
    sets = met.groupBy(F.col("b").alias("id")).agg(set_of("material", "materials"), set_of("year", "years"), set_of("chunk_id", "chunk_ids"))
    # Every one has a chunk, so the outer join loses and adds nothing; what asks for no set doesn't make any.
    out = e.join(sets, "id", "left").select(F.col("id").alias("node_id"), "name", F.col("type").alias("entity_kind"), "confidence", "n_mentions", "materials", "years", "chunk_ids", F.array("id").alias("node_ids"))
    return _ranked(out, ("confidence", "n_mentions"), limit, "node_id")


def chunks_by_topic(g: GraphTables, material_terms: Sequence[str], year: int | None = None, limit: int | None = 30) -> DataFrame:
    """(chunk_id) of all rows of ``experiments_publications_by_topic``, as rows of their own: few nodes may share most of a
    corpus's chunks, which a node's list would have to hold at once."""
    chunks, e = _by_topic(g, named(g.of_type("Material"), material_terms), year, limit)
    e = g.of_type(*TOPICAL) if limit is None else e  # without a limit, all that are in these chunks
    return chunks.join(mentioned(g.mentions_of(*TOPICAL), e).select("chunk_id"), "chunk_id", "left_semi")


def processes_by_either(g: GraphTables, process_terms: Sequence[str], material_terms: Sequence[str]) -> DataFrame:
    """Processes by name or by a chunk shared with a material found."""
    processes = g.of_type("Process")
    # Whether a chunk is shared is all that is asked, so mentions are cut down by chunks and no pairs are made.
    shared = mentioned(g.mentions_of("Material"), named(g.of_type("Material"), material_terms)).select("chunk_id").distinct()
    met = g.mentions_of("Process").join(shared, "chunk_id", "left_semi").select(F.col("entity_id").alias("id"))
    return processes.join(named(processes, process_terms).select("id").unionByName(met).distinct(), "id", "left_semi")


def mine_water_injection(g: GraphTables, process_terms: Sequence[str], material_terms: Sequence[str], param_terms: Sequence[str] = (), limit: int | None = 30) -> DataFrame:
    """Processes by name or by a chunk shared with a material found, with what their chunks and documents say."""
    p = _once(_ranked(processes_by_either(g, process_terms, material_terms), ("is_tech_solution", "confidence", "n_mentions"), limit, "id"), limit)
    out = p.join(document_sets(g, p, "Process").drop("doc_ids"), "id", "left").join(constraint_sets(g, p, param_terms, "Process"), "id", "left").join(chunk_sets(g, p, "Process"), "id", "left")
    out = out.select(F.col("id").alias("node_id"), *NODE, or_empty("doc_geographies"), or_empty("constraints", CONSTRAINT), or_empty("chunk_ids"), F.array("id").alias("node_ids"))
    return _ranked(out, ("is_tech_solution", "confidence", "n_mentions"), limit, "node_id")


def compare_ru_foreign(g: GraphTables, terms: Sequence[str], limit: int | None = 50) -> DataFrame:
    """Entities of any type by name, in order of their geography."""
    first = lambda rows, *by: rows if limit is None else rows.orderBy(*(F.col(c).asc_nulls_last() if "geography" in c else F.col(c).desc_nulls_last() for c in by[:-1]), by[-1]).limit(limit)
    n = _once(first(named(g.entities, terms), "geography", "confidence", "n_mentions", "id"), limit)
    out = n.join(document_sets(g, n), "id", "left").join(chunk_sets(g, n), "id", "left")
    out = out.select(F.col("id").alias("node_id"), "name", "name_en", F.col("type").alias("entity_type"), F.col("geography").alias("node_geography"), or_empty("doc_geographies"), or_empty("doc_ids"), "confidence", "n_mentions", or_empty("chunk_ids"), F.array("id").alias("node_ids"))
    return first(out, "node_geography", "confidence", "n_mentions", "node_id")


def gap_sides(materials: DataFrame, processes: DataFrame) -> tuple[DataFrame, DataFrame]:
    m = materials.select(F.col("id").alias("material_id"), F.col("name").alias("material_name"), F.coalesce("n_mentions", F.lit(0)).cast("long").alias("material_n_mentions"))
    p = processes.select(F.col("id").alias("process_id"), F.col("name").alias("process_name"), F.coalesce("n_mentions", F.lit(0)).cast("long").alias("process_n_mentions"))
    return m, p


def gap_known(g: GraphTables, materials: DataFrame, processes: DataFrame) -> DataFrame:
    """(material_id, process_id, linked, n_sources, chunk_ids): the pairs that a practice relation or a chunk joins. They are
    as many as relations and mentions make, not the two lists multiplied; every other pair is a gap without sources."""
    ids = materials.select(F.col("id").alias("material_id")).distinct()
    keys = ["material_id", "process_id"]
    linked = neighbours(g.relations, PRACTICE, processes).select(F.col("b").alias("material_id"), F.col("a").alias("process_id")).join(ids, "material_id", "left_semi").withColumn("linked", F.lit(True))
    met = co_mentions(g.mentions_of("Material"), materials, processes, g.mentions_of("Process")).groupBy(F.col("a").alias("material_id"), F.col("b").alias("process_id")).agg(set_of("chunk_id", "chunk_ids"))
    return linked.join(met, keys, "full").select(*keys, F.coalesce("linked", F.lit(False)).alias("linked"), or_empty("chunk_ids")).withColumn("n_sources", F.size("chunk_ids").cast("long"))


def gap_pairs(g: GraphTables, materials: DataFrame, processes: DataFrame) -> DataFrame:
    """Every material and process pair without a practice relation, with the chunks that mention both.

    The number of rows is that of the two filtered lists multiplied; what asks for the first ones in some order takes
    ``first_gaps``, and counts are ``gap_totals``.
    """
    m, p = gap_sides(materials, processes)
    return _gap_columns(m.crossJoin(p).join(gap_known(g, materials, processes), ["material_id", "process_id"], "left").filter(~F.coalesce("linked", F.lit(False))))


def _gap_columns(pairs: DataFrame) -> DataFrame:
    return pairs.select("material_id", "material_name", "process_id", "process_name", F.coalesce("n_sources", F.lit(0)).alias("n_sources"), or_empty("chunk_ids"), F.array("material_id", "process_id").alias("node_ids"), "material_n_mentions", "process_n_mentions")


def first_gaps(g: GraphTables, materials: DataFrame, processes: DataFrame, order: Sequence[Column], process_order: Sequence[Column], limit: int | None = None, per_material: int | None = None, kind: Column | None = None) -> DataFrame:
    """Gaps among which are the first ``per_material`` of each material, or else the first ``limit`` of all, in ``order``;
    the rows to rank, not yet ranked, without making every pair.

    For one material, gaps without sources must come in ``process_order`` among processes of one ``kind`` (all of them,
    where not given). So its first k are those at the first places that no known pair holds, and lie within
    its first k + known ones. Among the first ``limit`` of all are only such materials (of a kind) whose own first gap is.
    Pairs with sources are all returned; they are no more than the mentions give.
    """
    m, p = (session.stored(x, "gaps") for x in gap_sides(materials, processes))
    known = session.stored(gap_known(g, m.select(F.col("material_id").alias("id")), p.select(F.col("process_id").alias("id"))), "gaps")
    kinds = p.withColumn("kind", F.lit("") if kind is None else kind)
    placed = kinds.withColumn("place", F.row_number().over(W.partitionBy("kind").orderBy(*process_order)).cast("long"))
    taken = known.select("material_id", "process_id").join(placed.select("process_id", "kind", "place"), "process_id").groupBy("material_id", "kind").agg(F.collect_set("place").alias("taken"))

    def unseen(of: DataFrame, k: int) -> DataFrame:
        free = of.join(taken, ["material_id", "kind"], "left").withColumn("taken", or_empty("taken", "array<bigint>"))
        places = F.slice(F.array_except(F.sequence(F.lit(1).cast("long"), F.size("taken").cast("long") + k), F.col("taken")), 1, k)
        rows = free.withColumn("place", F.explode(places)).drop("taken").join(placed, ["kind", "place"])
        return rows.withColumn("n_sources", F.lit(0).cast("long")).withColumn("chunk_ids", F.array().cast("array<string>"))

    seen = _gap_columns(known.filter("not linked and n_sources > 0").join(m, "material_id").join(p, "process_id"))
    some = m.join(kinds.select("kind").distinct(), how="cross")
    if per_material is not None:
        return _gap_columns(unseen(some, per_material)).unionByName(seen) if per_material > 0 else seen.limit(0)
    if not limit:
        return seen.limit(0)
    best = session.stored(unseen(some, 1).orderBy(*order).limit(limit).select("material_id", "kind").distinct(), "gaps")
    return _gap_columns(unseen(some.join(best, ["material_id", "kind"], "left_semi"), limit)).unionByName(seen)


def gap_totals(g: GraphTables, materials: DataFrame, processes: DataFrame) -> DataFrame:
    """(material_id, n_gaps, n_unseen, most): how many gaps a material has, how many without sources, and the most sources."""
    m, p = (session.stored(x, "gaps") for x in gap_sides(materials, processes))
    known = gap_known(g, m.select(F.col("material_id").alias("id")), p.select(F.col("process_id").alias("id"))).join(p.select("process_id"), "process_id")
    known = known.groupBy("material_id").agg(F.count_if("linked").alias("linked"), F.count_if(~F.col("linked") & (F.col("n_sources") > 0)).alias("seen"), F.max(F.when(~F.col("linked"), F.col("n_sources"))).alias("most"))
    rows = m.groupBy("material_id").agg(F.count(F.lit(1)).alias("rows")).join(known, "material_id", "left").crossJoin(p.agg(F.count(F.lit(1)).alias("all")))
    gaps = F.col("all") - F.coalesce("linked", F.lit(0))
    out = rows.select("material_id", (F.col("rows") * gaps).alias("n_gaps"), (F.col("rows") * (gaps - F.coalesce("seen", F.lit(0)))).alias("n_unseen"), F.coalesce("most", F.lit(0)).alias("most"))
    return out.filter("n_gaps > 0")


def gap_lists(g: GraphTables, material_terms: Sequence[str], process_terms: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Materials and technical solutions found by name; two empty lists are refused."""
    if not material_terms and not process_terms:
        raise ValueError("gap_matrix needs terms for materials or processes")
    return named(g.of_type("Material"), material_terms), named(g.of_type("Process").filter("is_tech_solution"), process_terms)


def gap_matrix(g: GraphTables, material_terms: Sequence[str], process_terms: Sequence[str], limit: int | None = 30) -> DataFrame:
    """Gaps between materials and technical solutions found by name, most sources first; no limit: every pair."""
    lists = gap_lists(g, material_terms, process_terms)
    if limit is None:
        return gap_pairs(g, *lists)
    order = [F.desc("n_sources"), F.asc("material_name"), F.asc("process_name"), F.asc("material_id"), F.asc("process_id")]
    return first_gaps(g, *lists, order, [F.asc("process_name"), F.asc("process_id")], limit).orderBy(*order).limit(limit)


def gap_cell_context(g: GraphTables, chunk_ids: DataFrame | None) -> DataFrame:
    """For given chunks (None: all): constraint texts and names of properties mentioned there."""
    asked = g.chunks.select("chunk_id") if chunk_ids is None else g.chunks.join(chunk_ids.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id")
    cut = lambda rows: rows if chunk_ids is None else rows.join(asked, "chunk_id", "left_semi")
    text = F.concat(F.col("param"), F.lit(" "), F.col("op"), F.lit(" "), number_text("norm_value"), F.lit(" "), F.col("norm_unit"))
    texts = cut(g.constraints).groupBy("chunk_id").agg(set_of(text, "constraint_texts"))
    properties = g.of_type("Property").select(F.col("id").alias("entity_id"), "name")
    names = cut(g.mentions_of("Property")).join(properties, "entity_id").groupBy("chunk_id").agg(set_of("name", "property_names"))
    return asked.join(texts, "chunk_id", "left").join(names, "chunk_id", "left").select("chunk_id", or_empty("constraint_texts"), or_empty("property_names"))


def number_text(column: str):
    """A number as text with one decimal at least and six at most."""
    text = F.regexp_replace(F.format_string("%.6f", F.col(column)), r"(\.\d+?)0+$", "$1")
    return F.when(F.col(column).isNull(), None).otherwise(text)


def geography_themes(g: GraphTables, min_mentions: int = 3, limit: int = 5000) -> DataFrame:
    """Materials and processes with enough mentions, and the geographies of their documents."""
    n = g.of_type("Material", "Process").filter(F.col("n_mentions") >= min_mentions).orderBy(F.desc("n_mentions"), "id").limit(limit)
    out = n.join(document_sets(g, n, "Material", "Process").drop("doc_ids"), "id", "left").orderBy(F.desc("n_mentions"), "id").limit(limit)
    return out.select(F.col("id").alias("node_id"), "name", F.col("type").alias("entity_type"), or_empty("doc_geographies"))


def subgraph_nodes(g: GraphTables, node_ids: DataFrame, max_nodes: int = 60) -> DataFrame:
    return most_mentioned(g.entities.join(node_ids.select("id").distinct(), "id", "left_semi"), max_nodes)


def most_mentioned(entities: DataFrame, max_nodes: int) -> DataFrame:
    return entities.orderBy(F.col("n_mentions").desc_nulls_last(), "id").limit(max_nodes).select("id", "name", "type", F.coalesce("is_tech_solution", F.lit(False)).alias("is_tech_solution"))


def subgraph_edges(g: GraphTables, kept: DataFrame) -> DataFrame:
    """Relations with both ends among the kept nodes."""
    ids = kept.select("id").distinct()
    inside = g.relations.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return inside.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "type", F.coalesce("confidence", F.lit(0.5)).alias("confidence"), (F.col("type") == CONTRADICTS).alias("is_contradicts"))


def contradiction_pairs(g: GraphTables, node_ids: DataFrame) -> DataFrame:
    ids = node_ids.select("id").distinct()
    found = g.relations.filter(F.col("type") == CONTRADICTS).join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    name = lambda side: g.entities.select(F.col("id").alias(f"node_{side}_id"), F.col("name").alias(f"name_{side}"))
    out = found.select(F.col("source_id").alias("node_a_id"), F.col("target_id").alias("node_b_id"), F.coalesce("doc_id", F.lit("")).alias("doc_id"), F.coalesce("chunk_id", F.lit("")).alias("chunk_id"))
    return out.join(name("a"), "node_a_id").join(name("b"), "node_b_id").select("node_a_id", "node_b_id", "name_a", "name_b", "doc_id", "chunk_id")


def recommendation_expert(g: GraphTables, chunk_ids: DataFrame, doc_ids: DataFrame, node_ids: DataFrame, limit: int | None = 3) -> DataFrame:
    """Experts mentioned in cited chunks or documents, or next to a node of the answer."""
    experts = g.of_type("Expert")
    mine = g.mentions_of("Expert").join(g.chunks.select("chunk_id", "doc_id"), "chunk_id")
    by_chunk = mine.join(chunk_ids.select("chunk_id").distinct(), "chunk_id", "left_semi")
    by_doc = mine.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi").select(*by_chunk.columns)
    matched = by_chunk.unionByName(by_doc).distinct()
    near = neighbours(g.relations, RELATION_TYPES, node_ids).select(F.col("b").alias("id"))
    found = experts.join(matched.select(F.col("entity_id").alias("id")).unionByName(near).distinct(), "id", "left_semi")
    sets = matched.groupBy(F.col("entity_id").alias("id")).agg(F.countDistinct("doc_id").alias("n"), set_of("chunk_id", "sample_chunk_ids"))
    out = found.join(sets, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("n_matched_sources"), or_empty("sample_chunk_ids"), F.coalesce("n_mentions", F.lit(0)).cast("long").alias("n_mentions"))
    return _ranked(out, ("n_matched_sources", "n_mentions"), limit, "id")


def recommendation_adjacent(g: GraphTables, node_ids: DataFrame) -> DataFrame:
    """Neighbours of the nodes by relation or shared chunk, without the nodes; all of them, for ranking before any limit."""
    ids = node_ids.select("id").distinct()
    near = neighbours(g.relations, RELATION_TYPES, ids).select("a", "b")
    mine = g.mentions.join(ids.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").select(F.col("entity_id").alias("a"), "chunk_id")
    met = mine.join(g.mentions.select(F.col("entity_id").alias("b"), "chunk_id"), "chunk_id").select("a", "b")
    pairs = near.unionByName(met).distinct().join(ids.select(F.col("id").alias("b")), "b", "left_anti")
    out = pairs.join(g.entities.select(F.col("id").alias("b"), "name", "type", F.coalesce("n_mentions", F.lit(0)).cast("long").alias("n_mentions")), "b")
    out = out.join(g.entities.select(F.col("id").alias("a"), F.col("name").alias("via_name")), "a")
    return out.select(F.col("b").alias("id"), "name", "type", F.col("a").alias("via_id"), "via_name", "n_mentions")


#: Templates that a question can be routed to.
TEMPLATES: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (desalination_methods, catholyte_circulation, experiments_publications_by_topic, mine_water_injection, compare_ru_foreign, gap_matrix)}

#: Those whose chunks are told without their rows' lists.
CHUNKS: dict[str, Callable[..., DataFrame]] = {"experiments_publications_by_topic": chunks_by_topic}


def execute(g: GraphTables, template: str, **params) -> dict[str, DataFrame]:
    """Rows of a template, the ids and chunks in them, and contradictions among the ids."""
    if template not in TEMPLATES:
        raise ValueError(f"SEARCH-008: no template {template!r}; there are {sorted(TEMPLATES)}")
    rows = TEMPLATES[template](g, **params)
    node_ids = rows.select(F.explode("node_ids").alias("id")).distinct()
    chunk_ids = CHUNKS[template](g, **params) if template in CHUNKS else rows.select(F.explode("chunk_ids").alias("chunk_id")).distinct()
    return {"rows": rows, "node_ids": node_ids, "chunk_ids": chunk_ids, "contradiction_pairs": contradiction_pairs(g, node_ids)}
