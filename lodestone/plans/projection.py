"""The star schema as a knowledge graph: parts are materials, suppliers processes, orders chunks, customers' years documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.operators.graph import CONTRADICTS, DESCRIBED, OPERATES, PRACTICE, PRODUCES, USES, GraphTables

#: Geography of each region.
GEOGRAPHY = {"EUROPE": "ru", "AFRICA": "foreign", "AMERICA": "foreign", "ASIA": "global", "MIDDLE EAST": "unknown"}


def project(spark: SparkSession, sf_dir: str, min_quantity: float = 0.0) -> GraphTables:
    """``min_quantity`` thins mentions to large lines; the graph's other parts stay.

    Entities and mentions are unions of a branch for each type, so a filter by type leaves the tables of the
    others unread; keys are counted and grouped as numbers. Mentions may repeat a pair.
    """
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = lambda prefix, c: F.concat(F.lit(f"{prefix}:"), F.col(c).cast("string"))
    where = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    geography = F.lit("unknown")
    for region, g in GEOGRAPHY.items():
        geography = F.when(F.col("r_name") == region, g).otherwise(geography)
    customers = t("customer").select("c_custkey", "c_name", "c_nationkey")
    placed = customers.join(F.broadcast(where), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", geography.alias("geography")).distinct()
    doc_id = lambda year: F.concat(F.col("o_custkey").cast("string"), F.lit("-"), year.cast("string"))
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.year("o_orderdate").alias("year"))
    chunks = orders.select(F.col("o_orderkey").cast("string").alias("chunk_id"), doc_id(F.col("year")).alias("doc_id"))
    documents = orders.select("o_custkey", "year").distinct().join(placed, F.col("o_custkey") == F.col("c_custkey")).select(doc_id(F.col("year")).alias("doc_id"), F.col("c_name").alias("title"), "year", "geography")
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", F.col("l_orderkey").cast("string").alias("chunk_id"))
    large = lines.filter(F.col("l_quantity") >= min_quantity) if min_quantity > 0 else lines
    parts = t("part").select("p_partkey", "p_name", "p_brand", "p_type")
    suppliers = t("supplier").select("s_suppkey", "s_name")
    of_part = large.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    # Of each type: rows of (key, order), and how its ids begin.
    said = {
        "Material": ("material", large.select(F.col("l_partkey").alias("key"), F.col("l_orderkey").alias("o"))),
        "Process": ("process", large.select(F.col("l_suppkey").alias("key"), F.col("l_orderkey").alias("o"))),
        "Experiment": ("experiment", of_part.select(F.col("p_brand").alias("key"), F.col("l_orderkey").alias("o"))),
        "Publication": ("publication", of_part.select(F.col("p_type").alias("key"), F.col("l_orderkey").alias("o"))),
        "Expert": ("expert", orders.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("o"))),
        "Property": ("property", orders.select(F.col("o_orderpriority").alias("key"), F.col("o_orderkey").alias("o"))),
    }
    mentions = reduce(DataFrame.unionByName, (rows.select(text(prefix, "key").alias("entity_id"), F.col("o").cast("string").alias("chunk_id"), F.lit(kind).alias("type")) for kind, (prefix, rows) in said.items()))
    kind = F.when(F.col("l_returnflag") == "N", USES).when(F.col("l_returnflag") == "A", PRODUCES).when(F.col("l_quantity") >= 49, CONTRADICTS)
    best = F.max(F.round(1 - F.col("l_discount"), 2)).alias("confidence"), F.count(F.lit(1)).alias("n_evidence"), F.min("chunk_id").alias("chunk_id")
    supply = lines.withColumn("type", kind).filter("type is not null").groupBy("l_suppkey", "l_partkey", "type").agg(*best)
    supply = supply.select(text("process", "l_suppkey").alias("source_id"), text("material", "l_partkey").alias("target_id"), "type", "confidence", "n_evidence", "chunk_id")
    described = parts.select(text("material", "p_partkey").alias("source_id"), text("publication", "p_type").alias("target_id"), F.lit(DESCRIBED).alias("type"), F.lit(None).cast("double").alias("confidence"), F.lit(1).cast("long").alias("n_evidence"), F.lit(None).cast("string").alias("chunk_id"))
    hottest = lines.filter("l_quantity = 50 and l_tax = 0.08").join(orders.select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    operates = hottest.groupBy("l_suppkey", "o_orderpriority").agg(*best)
    operates = operates.select(text("process", "l_suppkey").alias("source_id"), text("property", "o_orderpriority").alias("target_id"), F.lit(OPERATES).alias("type"), "confidence", "n_evidence", "chunk_id")
    relations = supply.unionByName(described).unionByName(operates).join(chunks, "chunk_id", "left")
    # The sources of practice relations, from the lines that make them.
    solutions = lines.filter(kind.isin(*PRACTICE)).select(F.col("l_suppkey").alias("key")).unionByName(hottest.select(F.col("l_suppkey").alias("key"))).distinct().withColumn("solves", F.lit(True))
    named = {
        "Material": parts.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_type").alias("name_en")),
        "Process": suppliers.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")),
        "Experiment": parts.select(F.col("p_brand").alias("key"), F.col("p_brand").alias("name")),
        "Publication": parts.select(F.col("p_type").alias("key"), F.col("p_type").alias("name")),
        "Expert": customers.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")),
        "Property": orders.select(F.col("o_orderpriority").alias("key"), F.col("o_orderpriority").alias("name")),
    }

    def of(kind: str) -> DataFrame:
        prefix, rows = said[kind]
        # Of many keys an exchange by key counts the orders; few ones are summed over (key, order) first.
        rows = rows.repartition("key") if kind in ("Material", "Process", "Expert") else rows
        out = named[kind].distinct().join(rows.groupBy("key").agg(F.countDistinct("o").alias("n")), "key", "left")
        out = out.join(solutions, "key", "left") if kind == "Process" else out.withColumn("solves", F.lit(False))
        name_en = F.col("name_en") if kind == "Material" else F.lit(None).cast("string").alias("name_en")
        return out.select(text(prefix, "key").alias("id"), F.lit(kind).alias("type"), "name", name_en, F.lit("unknown").alias("geography"), F.coalesce("solves", F.lit(False)).alias("is_tech_solution"), F.lit(0.9).alias("confidence"), F.coalesce("n", F.lit(0)).alias("n_mentions"))

    entities = reduce(DataFrame.unionByName, map(of, said))
    constraints = lines.filter("l_quantity >= 45").select("chunk_id", F.lit("flow rate").alias("param"), F.lit("=").alias("op"), F.col("l_quantity").alias("norm_value"), F.lit(None).cast("double").alias("value_max"), F.lit("units").alias("norm_unit"), F.lit("").alias("source_text"))
    rates = lines.filter("l_discount = 0.1").select("chunk_id", F.lit("discount").alias("param"), F.lit("<=").alias("op"), (F.col("l_discount") * 100).alias("norm_value"), F.lit(None).cast("double").alias("value_max"), F.lit("%").alias("norm_unit"), F.lit("").alias("source_text"))
    constraints = constraints.unionByName(rates.withColumn("norm_value", F.round("norm_value", 6))).distinct()
    return GraphTables(documents, chunks, entities, relations, mentions, constraints)


def frame(spark: SparkSession, kind: str, values: list[str]) -> DataFrame:
    """A row for each value, of a size that plans know, so that it is sent to the big side's partitions."""
    return spark.range(1).select(F.explode(F.array(*map(F.lit, values)).cast("array<string>")).alias(kind))


#: The same projection as SQL common table expressions; {thin} is a condition on lines that mentions need.
SQL = """
geo AS (SELECT n_nationkey, CASE r_name WHEN 'EUROPE' THEN 'ru' WHEN 'AFRICA' THEN 'foreign' WHEN 'AMERICA' THEN 'foreign' WHEN 'ASIA' THEN 'global' ELSE 'unknown' END AS geography
  FROM nation JOIN region ON n_regionkey = r_regionkey),
ord AS (SELECT o_orderkey, o_custkey, o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(o_custkey AS VARCHAR) || '-' || CAST(year(o_orderdate) AS VARCHAR) AS doc_id, CAST(o_orderkey AS VARCHAR) AS chunk_id FROM orders),
g_documents AS (SELECT DISTINCT doc_id, c_name AS title, year, geography FROM ord JOIN customer ON o_custkey = c_custkey JOIN geo ON c_nationkey = n_nationkey),
g_chunks AS (SELECT chunk_id, doc_id FROM ord),
lines AS (SELECT *, CAST(l_orderkey AS VARCHAR) AS chunk_id FROM lineitem),
g_mentions AS (
  SELECT 'material:' || CAST(l_partkey AS VARCHAR) AS entity_id, chunk_id FROM lines WHERE {thin}
  UNION SELECT 'process:' || CAST(l_suppkey AS VARCHAR), chunk_id FROM lines WHERE {thin}
  UNION SELECT 'experiment:' || p_brand, chunk_id FROM lines JOIN part ON l_partkey = p_partkey WHERE {thin}
  UNION SELECT 'publication:' || p_type, chunk_id FROM lines JOIN part ON l_partkey = p_partkey WHERE {thin}
  UNION SELECT 'expert:' || CAST(o_custkey AS VARCHAR), chunk_id FROM ord
  UNION SELECT 'property:' || o_orderpriority, chunk_id FROM ord),
rel AS (
  SELECT 'process:' || CAST(l_suppkey AS VARCHAR) AS source_id, 'material:' || CAST(l_partkey AS VARCHAR) AS target_id,
    CASE WHEN l_returnflag = 'N' THEN 'USES_MATERIAL' WHEN l_returnflag = 'A' THEN 'PRODUCES_OUTPUT' WHEN l_quantity >= 49 THEN 'CONTRADICTS' END AS type, round(1 - l_discount, 2) AS c, chunk_id FROM lines
  UNION ALL SELECT 'process:' || CAST(l_suppkey AS VARCHAR), 'property:' || o_orderpriority, 'OPERATES_AT_CONDITION', round(1 - l_discount, 2), lines.chunk_id FROM lines JOIN ord ON lines.chunk_id = ord.chunk_id WHERE l_quantity = 50 AND l_tax = 0.08),
g_relations AS (
  SELECT r.*, doc_id FROM (
    SELECT source_id, target_id, type, max(c) AS confidence, count(*) AS n_evidence, min(chunk_id) AS chunk_id FROM rel WHERE type IS NOT NULL GROUP BY ALL
    UNION ALL SELECT 'material:' || CAST(p_partkey AS VARCHAR), 'publication:' || p_type, 'DESCRIBED_IN', NULL, 1, NULL FROM part) r
  LEFT JOIN g_chunks ON r.chunk_id = g_chunks.chunk_id),
ent AS (
  SELECT 'material:' || CAST(p_partkey AS VARCHAR) AS id, 'Material' AS type, p_name AS name, p_type AS name_en FROM part
  UNION SELECT 'process:' || CAST(s_suppkey AS VARCHAR), 'Process', s_name, NULL FROM supplier
  UNION SELECT 'experiment:' || p_brand, 'Experiment', p_brand, NULL FROM part
  UNION SELECT 'publication:' || p_type, 'Publication', p_type, NULL FROM part
  UNION SELECT 'expert:' || CAST(c_custkey AS VARCHAR), 'Expert', c_name, NULL FROM customer
  UNION SELECT 'property:' || o_orderpriority, 'Property', o_orderpriority, NULL FROM ord),
g_entities AS (
  SELECT id, type, name, name_en, 'unknown' AS geography, coalesce(solves, false) AS is_tech_solution, 0.9::DOUBLE AS confidence, coalesce(n, 0) AS n_mentions FROM ent
  LEFT JOIN (SELECT entity_id, count(*) AS n FROM g_mentions GROUP BY 1) ON entity_id = id
  LEFT JOIN (SELECT DISTINCT source_id, true AS solves FROM g_relations WHERE type IN ('USES_MATERIAL', 'OPERATES_AT_CONDITION', 'PRODUCES_OUTPUT')) ON source_id = id),
g_constraints AS (
  SELECT DISTINCT chunk_id, 'flow rate' AS param, '=' AS op, l_quantity AS norm_value, 'units' AS norm_unit FROM lines WHERE l_quantity >= 45
  UNION SELECT DISTINCT chunk_id, 'discount', '<=', round(l_discount * 100, 6), '%' FROM lines WHERE l_discount = 0.1),
practice AS (SELECT source_id AS a, target_id AS b FROM g_relations WHERE type IN ('USES_MATERIAL', 'OPERATES_AT_CONDITION', 'PRODUCES_OUTPUT') UNION SELECT target_id, source_id FROM g_relations WHERE type IN ('USES_MATERIAL', 'OPERATES_AT_CONDITION', 'PRODUCES_OUTPUT')),
near AS (SELECT source_id AS a, target_id AS b, type FROM g_relations UNION SELECT target_id, source_id, type FROM g_relations)
"""


def sql(body: str, thin: str = "true") -> str:
    return "WITH " + SQL.strip().replace("{thin}", thin) + body
