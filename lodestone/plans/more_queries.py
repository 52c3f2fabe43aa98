"""Queries on routing, merging within a chunk, running lines, recommendations and the parts of the templates."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from lodestone.functions import chunking, terms
from lodestone.operators import build, graph as gr
from lodestone.plans import gaps, templates
from lodestone.plans.catalog import query
from lodestone.plans.data_queries import _extractions, table
from lodestone.plans.graph_queries import _ADJACENT, _DS, _GAP, _M, _P, IDS, MATERIALS, NODES, PROCESSES, _co, _constraints
from lodestone.plans.projection import frame, project, sql

# Questions made of an order's columns: a topic by its customer, years and places by its key.
_ASK = """CASE o_custkey % 6 WHEN 0 THEN 'Методы обессоливания воды' WHEN 1 THEN 'Циркуляция католита' WHEN 2 THEN 'Распределение между штейном и шлаком' WHEN 3 THEN 'Закачка шахтных вод' WHEN 4 THEN 'reverse osmosis for mine water' ELSE 'Сколько стоит обед' END
|| CASE o_orderkey % 5 WHEN 0 THEN ' за последние 5 лет' WHEN 1 THEN ' в 1995–1997 годах' WHEN 2 THEN ' с 1996 года' WHEN 3 THEN ' с 1996 года, за последние 3 года' ELSE '' END
|| CASE o_orderkey % 7 WHEN 0 THEN ' в России и за рубежом' WHEN 1 THEN ', зарубежный опыт' WHEN 2 THEN ', отечественные работы' WHEN 3 THEN ', мировая практика' ELSE '?' END"""


def _routed(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_ASK).alias("question"))
    return terms.routed(asked, this_year=2026)


@query("SELECT o_orderkey, CASE o_custkey % 6 WHEN 0 THEN 'desalination_methods' WHEN 1 THEN 'catholyte_circulation' WHEN 2 THEN 'experiments_publications_by_topic' WHEN 3 THEN 'mine_water_injection' WHEN 4 THEN 'desalination_methods' ELSE 'rag_fallback' END AS template FROM orders")
def C29_template(spark, sf_dir):
    return _routed(spark, sf_dir).select("o_orderkey", "template")


@query("SELECT o_orderkey, CASE o_custkey % 6 WHEN 0 THEN 'обессоливание' WHEN 4 THEN 'обратный осмос' WHEN 3 THEN 'закачка шахтных вод' END AS process, CASE o_custkey % 6 WHEN 1 THEN 'католит' WHEN 2 THEN 'штейн' WHEN 3 THEN 'шахтные воды' END AS material, CAST(NULL AS VARCHAR) AS property FROM orders")
def C25_C26_slots(spark, sf_dir):
    return _routed(spark, sf_dir).select("o_orderkey", "process", "material", "property")


@query("SELECT o_orderkey, CAST(CASE o_orderkey % 5 WHEN 0 THEN 2022 WHEN 1 THEN 1995 WHEN 2 THEN 1996 WHEN 3 THEN 2024 END AS INTEGER) AS year_from, CAST(CASE o_orderkey % 5 WHEN 1 THEN 1997 END AS INTEGER) AS year_to FROM orders")
def C27_years(spark, sf_dir):
    return _routed(spark, sf_dir).select("o_orderkey", "year_from", "year_to")


@query("SELECT o_orderkey, CASE o_orderkey % 7 WHEN 1 THEN 'foreign' WHEN 2 THEN 'ru' END AS geography, o_orderkey % 7 IN (0, 3) AS compare_geography FROM orders")
def C28_geography_intent(spark, sf_dir):
    return _routed(spark, sf_dir).select("o_orderkey", "geography", "compare_geography")


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct([lower(p_type), 'cheap', 'economy', 'promo'])), ',') AS terms, array_to_string(list_sort(list_distinct(list_filter([lower(p_type), 'cheap', 'economy', 'promo'], lambda x: length(x) >= 6))), ',') AS long_terms FROM part WHERE p_type IN ('ECONOMY', 'PROMO') UNION ALL SELECT p_partkey, lower(p_type), CASE WHEN length(p_type) >= 6 THEN lower(p_type) ELSE '' END FROM part WHERE p_type NOT IN ('ECONOMY', 'PROMO')")
def C18_C19_expansion(spark, sf_dir):
    thesaurus = terms.Thesaurus([("cheap", "Material", ("Economy", "promo"))])
    return thesaurus.expanded(table(spark, sf_dir, "part"), "p_type", "terms").withColumn("long_terms", F.array_join(F.filter("terms", lambda x: F.length(x) >= 6), ",")).withColumn("terms", F.array_join("terms", ",")).select("p_partkey", "terms", "long_terms")


@query(r"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS page, count(*) OVER (PARTITION BY conv_id) AS pages, text FROM conversations),
l AS (SELECT conv_id, page, pages, coalesce(array_to_string(list_filter(string_split(replace(text, E'\r', E'\n'), E'\n'), lambda x: trim(x, E' \t') <> ''), E'\n'), '') AS body FROM t)
SELECT conv_id, string_agg(CASE WHEN pages >= 3 THEN body ELSE 'Running head 12' || CASE WHEN body = '' THEN '' ELSE E'\n' || body END END, E'\n' ORDER BY page) AS text FROM l GROUP BY conv_id""")
def C1_E14_running_lines(spark, sf_dir):
    """Turns as pages, each with a running head and a page number."""
    page = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text"))
    pages = table(spark, sf_dir, "conversations").withColumn("page", page)
    head = F.concat(F.lit("Running head "), F.when(F.count(F.lit(1)).over(W.partitionBy("conv_id")) >= 3, F.col("page") + 11).otherwise(12).cast("string"))
    made = F.concat_ws("\n", head, F.coalesce("text", F.lit("")), F.col("page").cast("string"))
    return chunking.without_boilerplate(pages.select(F.col("conv_id").alias("doc_id"), "page", made.alias("text"))).withColumnRenamed("doc_id", "conv_id")


_LINES = "l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query(f"WITH {_LINES} SELECT l_orderkey AS row_ord, p_name AS name, 'Material' AS type, array_to_string(list_sort(list_distinct(list(p_type))), ',') AS synonyms, arg_max(p_brand, k) AS brand FROM l GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY l_orderkey, p_name"))
def E11_merged_in_chunk(spark, sf_dir):
    found = build.merged_in_chunk(_extractions(spark, sf_dir), terms.Thesaurus()).filter("type = 'Material'")
    return found.select("row_ord", "name", "type", F.array_join(F.array_sort("synonyms"), ",").alias("synonyms"), F.col("attrs")["brand"].alias("brand"))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS chunk_id, 'Maker ' || l_suppkey AS source, p_name AS target, p_name NOT IN (SELECT p_name FROM part WHERE p_size > 40) AS kept, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def D12_kept_relations(spark, sf_dir):
    """Large parts are struck from the entities of the records, so relations to them lose an end."""
    known = _extractions(spark, sf_dir)
    sizes = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), "p_size").filter("p_size > 40").groupBy("name").agg(F.lit(True).alias("big"))
    kept = known.select("row_ord", F.explode("entities.name").alias("name")).join(sizes, "name", "left").filter("big is null")
    return build.marked_relations(known, terms.Thesaurus(), kept).groupBy("chunk_id", "source", "target", "kept").agg(F.count(F.lit(1)).alias("n"))


@query(sql(f", {_co('flow')} SELECT e.id, coalesce(constraints, '') AS constraints FROM g_entities e JOIN (SELECT DISTINCT entity_id FROM g_mentions JOIN g_constraints USING (chunk_id)) h ON h.entity_id = e.id LEFT JOIN co ON co.id = e.id WHERE type IN ('Process', 'Publication')"))
def D2_optional_filter(spark, sf_dir):
    """The filter trims the collected list; nodes without anything left in it stay."""
    g = project(spark, sf_dir)
    return gr.constraint_sets(g, g.of_type("Process", "Publication"), ["flow"], "Process", "Publication").select("id", _constraints())


@query(sql(f", {_co('')} SELECT co.id, constraints FROM co JOIN g_entities e ON e.id = co.id WHERE type = 'Experiment'"))
def E2_constraint_sets(spark, sf_dir):
    g = project(spark, sf_dir)
    return gr.constraint_sets(g, g.of_type("Experiment"), [], "Experiment").select("id", _constraints())


@query(sql(" SELECT entity_id AS id, count(DISTINCT chunk_id) AS n, md5(string_agg(DISTINCT chunk_id, ',' ORDER BY chunk_id)) AS md5 FROM g_mentions JOIN g_entities ON id = entity_id WHERE type = 'Publication' GROUP BY 1"))
def E1_E4_chunk_sets(spark, sf_dir):
    g = project(spark, sf_dir)
    return gr.chunk_sets(g, g.of_type("Publication"), "Publication").select("id", F.size("chunk_ids").cast("long").alias("n"), F.md5(F.array_join("chunk_ids", ",")).alias("md5"))


@query(sql(f", {_M}, {_P} SELECT id FROM p UNION SELECT b.entity_id FROM g_mentions a JOIN g_mentions b USING (chunk_id) WHERE a.entity_id IN (SELECT id FROM m) AND b.entity_id IN (SELECT id FROM g_entities WHERE type = 'Process')"))
def D7_either_pattern(spark, sf_dir):
    return templates.processes_by_either(project(spark, sf_dir), PROCESSES, MATERIALS).select("id")


@query(sql(f" SELECT a, b FROM near WHERE a IN ({IDS}) GROUP BY ALL"))
def J1_one_hop(spark, sf_dir):
    return gr.neighbours(project(spark, sf_dir).relations, gr.RELATION_TYPES, frame(spark, "id", NODES))


@query(sql(_ADJACENT + " SELECT DISTINCT id, via_id FROM adj"))
def H1_union_of_paths(spark, sf_dir):
    return templates.recommendation_adjacent(project(spark, sf_dir), frame(spark, "id", NODES)).select("id", "via_id").distinct()


@query(sql(" SELECT e.id, count(DISTINCT doc_id) AS n FROM g_entities e JOIN g_mentions ON entity_id = e.id JOIN g_chunks USING (chunk_id) WHERE type = 'Expert' AND chunk_id IN (SELECT chunk_id FROM g_chunks) GROUP BY 1"))
def E3_count_distinct(spark, sf_dir):
    g = project(spark, sf_dir)
    # Every chunk is cited, so citing documents too would add none.
    return templates.recommendation_expert(g, g.chunks, frame(spark, "doc_id", []), frame(spark, "id", []), None).select("id", F.col("n_matched_sources").alias("n"))


@query(sql(f", {_DS} SELECT e.id AS node_id, coalesce(doc_ids, '') AS doc_ids, e.id AS first_id FROM g_entities e LEFT JOIN ds ON ds.id = e.id WHERE contains(lower(name), 'ring') OR contains(lower(coalesce(name_en, '')), 'ring')"))
def H3_document_ids(spark, sf_dir):
    rows = templates.compare_ru_foreign(project(spark, sf_dir), MATERIALS, None)
    return rows.select("node_id", F.array_join("doc_ids", ",").alias("doc_ids"), F.col("node_ids")[0].alias("first_id"))


@query(sql(f", {_M} SELECT DISTINCT id FROM m"))
def E16_node_ids(spark, sf_dir):
    return templates.execute(project(spark, sf_dir), "compare_ru_foreign", terms=MATERIALS, limit=None)["node_ids"].filter("id like 'material:%'")


@query(sql(_GAP + " SELECT material_id, process_id, row_number() OVER (ORDER BY n_sources, CASE WHEN lower(trim(material_name)) = 'none' THEN 0 ELSE 2 END, mm + pm DESC, material_name, process_name, material_id, process_id) AS place FROM cells QUALIFY place <= 500"))
def G5_report_order(spark, sf_dir):
    rows, order = gaps.first_cells(project(spark, sf_dir), MATERIALS, PROCESSES, limit=500, first=[("none", "none")])
    top = rows.orderBy(*order).limit(500)
    return top.select("material_id", "process_id", F.row_number().over(W.orderBy(*order)).cast("long").alias("place"))


@query("SELECT kind, count(*) AS n, arg_min(id, place) AS first_id, CASE kind WHEN 'similar_case' THEN 1 WHEN 'expert' THEN 2 WHEN 'adjacent_topic' THEN 3 ELSE 4 END AS rank FROM (SELECT CASE p_size % 4 WHEN 0 THEN 'expert' WHEN 1 THEN 'adjacent_topic' WHEN 2 THEN 'similar_case' ELSE 'other' END AS kind, p_partkey AS place, 'p' || p_partkey AS id FROM part) GROUP BY kind")
def E17_grouped(spark, sf_dir):
    kind = F.expr("CASE p_size % 4 WHEN 0 THEN 'expert' WHEN 1 THEN 'adjacent_topic' WHEN 2 THEN 'similar_case' ELSE 'other' END")
    items = table(spark, sf_dir, "part").select(kind.alias("kind"), F.col("p_partkey").alias("place"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("title"), F.lit("").alias("reason"), F.lit(0.0).alias("score"))
    found = gaps.grouped(items).withColumn("rank", F.monotonically_increasing_id())
    place = F.row_number().over(W.orderBy("rank")).alias("rank")
    return found.select("kind", F.size("items").cast("long").alias("n"), F.col("items")[0]["id"].alias("first_id"), place)


@query(sql(_ADJACENT + f""", ex AS (SELECT * FROM g_entities WHERE type = 'Expert'), hit AS (SELECT entity_id, doc_id FROM g_mentions JOIN g_chunks USING (chunk_id) JOIN ex ON ex.id = entity_id WHERE chunk_id IN ('1', '2', '3') OR doc_id IN (SELECT doc_id FROM g_chunks WHERE chunk_id IN ('1', '2', '3'))),
e AS (SELECT ex.id, name, n_mentions, count(DISTINCT doc_id) AS n FROM ex LEFT JOIN hit ON entity_id = ex.id WHERE entity_id IS NOT NULL OR EXISTS (SELECT 1 FROM near WHERE a = ex.id AND b IN ({IDS})) GROUP BY ALL ORDER BY n DESC, n_mentions DESC, ex.id LIMIT 3),
t AS (SELECT * FROM adj QUALIFY row_number() OVER (PARTITION BY id ORDER BY n_mentions DESC, via_id) = 1),
a AS (SELECT * FROM t ORDER BY type IN ('Material', 'Process', 'Property') DESC, n_mentions DESC, id LIMIT 3)
SELECT 'expert' AS kind, CAST(row_number() OVER (ORDER BY n DESC, n_mentions DESC, id) AS INTEGER) AS place, id, name AS title FROM e
UNION ALL SELECT 'adjacent_topic', CAST(row_number() OVER (ORDER BY type IN ('Material', 'Process', 'Property') DESC, n_mentions DESC, id) AS INTEGER), id, name FROM a"""))
def Q_recommendations(spark, sf_dir):
    """Without a vector of the question the similar cases fail, and the other kinds stay."""
    g = project(spark, sf_dir)
    cited = g.chunks.join(frame(spark, "chunk_id", ["1", "2", "3"]), "chunk_id", "left_semi").select("chunk_id", "doc_id")
    return gaps.recommendations(g, None, cited, frame(spark, "id", NODES)).select("kind", "place", "id", "title")
