"""Queries on documents, events, embeddings and other tables: text functions, upserts, vector search, aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import session
from lodestone.functions import chunking, constraints, text
from lodestone.functions.terms import Thesaurus
from lodestone.operators import build, upsert, vector
from lodestone.plans import gaps
from lodestone.plans.catalog import query
from lodestone.sources import corpus

# Frequent words of the synthetic documents, in place of markers and topics.
SIDE_A, SIDE_B = ("the", "and", "of", "with", "from"), ("der", "und", "die", "von", "mit", "la", "de", "en")
TOPICS = {"english": ("the", "there", "with"), "german": ("der", "und"), "french": ("dans", "pour"), "none": ("zzzz",)}


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '(?m)^ +| +$', '', 'g'), '\n{3,}', E'\n\n', 'g'), E' \n\t')) AS clean_md5 FROM documents")
def C2_clean_whitespace(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.clean_whitespace(F.col("text"))).alias("clean_md5"))


@query("SELECT doc_id, CASE WHEN len(regexp_extract_all(substr(text, 1, 5000), '[a-zA-Z]')) = 0 THEN 'ru' ELSE 'en' END AS detected FROM documents")
def C4_detect_lang(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.detect_lang(F.col("text")).alias("detected"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '%HIGH%' THEN trim(o_orderpriority) ELSE replace('order_' || o_orderkey, '_', ' ') END AS title FROM orders")
def C5_title(spark, sf_dir):
    named = F.when(F.col("o_orderpriority").contains("HIGH"), F.col("o_orderpriority")).otherwise("Document")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.title(named, F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"))).alias("title"))


@query("SELECT o_orderkey, CAST(CASE WHEN year(o_orderdate) BETWEEN 1950 AND 2001 THEN year(o_orderdate) END AS INTEGER) AS y FROM orders")
def C6_year(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    y = F.year("o_orderdate")
    stem = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("a 1901 b "), y.cast("string"))).otherwise("plain 2999")
    return rows.select("o_orderkey", text.year(stem, F.lit(None).cast("int"), F.concat(F.lit("on "), y.cast("string"), F.lit(" and 1999")), 2000).alias("y"))


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(string_split_regex(p_name || ';' || p_brand || ' / ' || p_type || ', ', '[;/\\n,]'), lambda x: trim(x)), lambda x: x <> ''), '|') AS authors FROM part".replace("\\\\n", "\\n"))
def C7_split_authors(spark, sf_dir):
    raw = F.concat("p_name", F.lit(";"), "p_brand", F.lit(" / "), "p_type", F.lit(", "))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.split_authors(raw), "|").alias("authors"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders")
def C8_year_of_pdf_date(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.year_of_pdf_date(F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMdd"))).alias("y"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[.!?…]+[”" + '"' + r"»)]?(\s|$)')) + CASE WHEN regexp_matches(text, '[.!?…]+[”" + '"' + r"»)]?$') THEN 0 WHEN text = '' THEN 0 ELSE 1 END AS BIGINT) AS n_sentences FROM documents")
def C9_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", chunking.n_sentences(F.col("text")).cast("long").alias("n_sentences"))


@query(rf"""WITH RECURSIVE p AS (SELECT doc_id, text, list_filter(string_split(regexp_replace(text, '([.!?…]+[”{chr(34)}»)]?)(\s|$)', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: x <> '') AS parts FROM documents WHERE text <> ''),
a AS (SELECT doc_id, text, list_transform(range(1, len(parts) + 1), lambda i: list_sum(list_transform(parts[1:i], lambda x: length(x)))::BIGINT) AS e FROM p),
s AS (SELECT doc_id, text, e, [0::BIGINT] || e[1:len(e) - 1] AS b FROM a),
i AS (SELECT doc_id, text, e, b, unnest(range(1, len(e) + 1)) AS k FROM s),
n AS (SELECT doc_id, text, e, b, k, greatest(k, len(list_filter(e, lambda x: x <= b[k] + 1500))) AS last FROM i),
j AS (SELECT doc_id, text, k, last, len(e) AS spans, b[k] AS lo, e[last] AS hi, least(last, len(list_filter(b, lambda x: x <= e[last] - 200))) AS back FROM n),
r AS (SELECT doc_id, 1::BIGINT AS k, 0 AS no FROM s UNION ALL SELECT r.doc_id, CASE WHEN j.back > j.k THEN j.back ELSE j.last + 1 END, no + 1 FROM r JOIN j USING (doc_id, k) WHERE j.last < j.spans),
c AS (SELECT doc_id, no, lo, substr(text, lo + 1, hi - lo) AS piece FROM r JOIN j USING (doc_id, k)),
t AS (SELECT doc_id, no, lo + length(piece) - length(ltrim(piece, E' \n\t\r')) AS start, trim(piece, E' \n\t\r') AS text FROM c)
SELECT doc_id || '#' || no AS chunk_id, CAST(doc_id AS VARCHAR) AS doc_id, text, CAST(start AS INTEGER) AS start, CAST(start + length(text) AS INTEGER) AS "end", CASE WHEN regexp_matches(text, '[a-zA-Z]') THEN 'en' ELSE 'ru' END AS lang FROM t WHERE text <> ''""")
def C11_chunks(spark, sf_dir):
    return chunking.chunk_table(table(spark, sf_dir, "documents"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity + 0.5 AS n FROM lineitem")
def C12_parse_number(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.parse_number(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" ,5"))).alias("n"))


@query(r"SELECT CAST(doc_id AS VARCHAR) AS chunk_id, CAST(len(regexp_extract_all(text, '[0-9]\s*%')) AS BIGINT) AS n FROM documents WHERE regexp_matches(text, '[0-9]\s*%')".replace("\\\\", "\\"))
def C13_percentages(spark, sf_dir):
    """The synthetic texts hold no unit but percent signs."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text")
    return constraints.constraint_table(docs).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))


# One sentence for each line number: phrase, range by words, sign, range by dash, and a parameter of any name.
_Q = "CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)"
_SAID = f"""CASE l_linenumber WHEN 1 THEN 'расход не более ' || {_Q} || ',5 г/л' WHEN 2 THEN 'температура от ' || {_Q} || ' до 90 °C' WHEN 3 THEN 'Раствор. Влажность ≥ ' || {_Q} || ' %'
WHEN 4 THEN 'сульфаты и хлориды по ' || {_Q} || '–60 мг/дм3' ELSE 'содержание меди составляет ' || {_Q} || ' т/сут' END"""
_PICK = lambda *v: "CASE l_linenumber " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(v[:4], 1)) + f" ELSE {v[4]} END"


@query(f"""SELECT CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber AS chunk_id, 0::INTEGER AS ord, {_PICK("'расход'", "'температура'", "'влажность'", "'хлориды'", "'содержание меди'")} AS param, {_PICK("'<='", "'range'", "'>='", "'range'", "'='")} AS op,
CAST(CAST(l_quantity AS INTEGER) + {_PICK("0.5", "0", "0", "0", "0")} AS DOUBLE) AS value, CAST({_PICK("NULL", "90", "NULL", "60", "NULL")} AS DOUBLE) AS value_max, {_PICK("'г/л'", "'°C'", "'%'", "'мг/дм3'", "'т/сут'")} AS unit,
CAST((CAST(l_quantity AS INTEGER) + {_PICK("0.5", "0", "0", "0", "0")}) * {_PICK("1000", "1", "1", "1", "1")} AS DOUBLE) AS norm_value, {_PICK("'мг/л'", "'°C'", "'%'", "'мг/л'", "'т/сут'")} AS norm_unit, {_SAID} AS source_text FROM lineitem""")
def C16_constraints(spark, sf_dir):
    said = table(spark, sf_dir, "lineitem").select(F.expr("cast(l_orderkey as string) || '-' || l_linenumber").alias("chunk_id"), F.expr(_SAID.replace("VARCHAR", "STRING")).alias("text"))
    return constraints.constraint_table(said)


@query("SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'cheap' WHEN 'PROMO' THEN 'cheap' ELSE p_type END AS canon FROM part")
def C17_canonical(spark, sf_dir):
    thesaurus = Thesaurus([("cheap", "Material", ("Economy", " promo "))])
    return thesaurus.canonicalised(table(spark, sf_dir, "part"), "p_type", "canon").select("p_partkey", "canon")


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug, 'material:' || trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') AS node_id FROM part")
def C20_slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"), text.node_id(F.lit("Material"), F.col("p_type")).alias("node_id"))


@query("SELECT o_orderkey, substr(sha1(o_orderkey || '|' || o_orderpriority), 1, 16) AS id FROM orders")
def C21_ids(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.short_sha1(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderpriority")).alias("id"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END AS other FROM part")
def C22_other_script_name(spark, sf_dir):
    canon = F.when(F.col("p_size") % 2 == 0, F.lit("никель")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", text.other_script_name(canon, F.array(F.lit("17"), "p_brand", "p_type")).alias("other"))


def _hits(words) -> str:
    return " + ".join(rf"CAST(regexp_matches(t, '(^|[^\p{{L}}\p{{N}}_]){w}') AS INTEGER)" for w in words)


@query(f"SELECT doc_id, CASE WHEN a >= 3 AND b >= 3 THEN 'global' WHEN a >= 3 THEN 'ru' WHEN b >= 3 THEN 'foreign' ELSE 'unknown' END AS geography, a AS ru_hits, b AS foreign_hits FROM (SELECT doc_id, {_hits(SIDE_A)} AS a, {_hits(SIDE_B)} AS b FROM (SELECT doc_id, lower(text) AS t FROM documents))")
def C23_geography(spark, sf_dir):
    found = text.geography(F.lower("text"), SIDE_A, SIDE_B)
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("g")).select("doc_id", "g.geography", "g.ru_hits", "g.foreign_hits")


def _count(words) -> str:
    return " + ".join(rf"len(regexp_extract_all(text, '(?i)(^|[^а-яёА-ЯЁa-zA-Z0-9]){w}'))" for w in words)


@query(" UNION ALL ".join(f"SELECT doc_id, '{t}' AS topic, CAST({_count(w)} AS BIGINT) AS n_hits FROM documents WHERE {_count(w)} > 0" for t, w in TOPICS.items()))
def C24_topic_hits(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    hits = F.array(*(F.struct(F.lit(t).alias("topic"), text.topic_hits(F.col("text"), w).cast("long").alias("n_hits")) for t, w in TOPICS.items()))
    return docs.select("doc_id", F.explode(hits).alias("h")).select("doc_id", "h.*").filter("n_hits > 0")


@query(f"SELECT topic, count(d) AS n FROM (SELECT unnest([{', '.join(repr(t) for t in TOPICS)}]) AS topic) LEFT JOIN ({' UNION ALL '.join(f'SELECT {t!r} AS t, doc_id AS d FROM documents WHERE {_count(w)} > 0' for t, w in TOPICS.items())}) ON t = topic GROUP BY topic")
def E12_topic_counts(spark, sf_dir):
    topics = spark.createDataFrame([(t,) for t in TOPICS], "topic string")
    found = C24_topic_hits(spark, sf_dir).groupBy("topic").count()
    return topics.join(found, "topic", "left").select("topic", F.coalesce("count", F.lit(0)).alias("n"))


@query("SELECT doc_id, CASE WHEN length(w) <= 300 THEN w ELSE (CASE WHEN contains(substr(w, 1, 300), ' ') THEN regexp_extract(substr(w, 1, 300), '^((?s).*) ', 1) ELSE substr(w, 1, 300) END) || '…' END AS quote FROM (SELECT doc_id, trim(text, E' \\n\\t') AS w FROM documents)")
def C31_quote(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.quote(F.col("text")).alias("quote"))


@query("SELECT doc_id, array_to_string(list_slice(string_split(text, '. '), 1, 2), '. ') AS start FROM documents")
def C34_first_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.first_sentences(F.col("text")).alias("start"))


@query("SELECT conv_id, turn, role, md5(regexp_replace(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '[?!.… ]+$', '')) AS key_md5 FROM conversations")
def C36_question_key(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.md5(text.question_key(F.col("text"))).alias("key_md5"))


@query("SELECT p_partkey, array_to_string(list_sort(string_split(lower(p_name), ' ')), ' ') AS key FROM part")
def C38_expert_key(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", gaps.expert_key(F.col("p_name")).alias("key"))


@query("SELECT p_partkey, title FROM (SELECT p_partkey, p_name AS title, row_number() OVER (PARTITION BY array_to_string(list_sort(string_split(lower(p_name), ' ')), ' ') ORDER BY p_partkey) AS n FROM part) WHERE n = 1")
def F6_distinct_experts(spark, sf_dir):
    return gaps.distinct_experts(table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_partkey").alias("ord"))).select("p_partkey", "title")


@query("SELECT o_custkey, CAST(min(year(o_orderdate)) AS INTEGER) AS year_from, CAST(max(year(o_orderdate)) AS INTEGER) AS year_to FROM orders GROUP BY 1")
def C39_year_range(spark, sf_dir):
    years = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(F.year("o_orderdate")).alias("y"))
    return years.select("o_custkey", F.array_min("y").alias("year_from"), F.array_max("y").alias("year_to"))


@query("SELECT doc_id, n_chars FROM documents WHERE length(text) >= 200")
def D17_long_enough(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.length("text") >= 200).select("doc_id", "n_chars")


@query("SELECT doc_id, source IN ('src0', 'src1') AS is_core FROM documents")
def D18_core_flag(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").isin("src0", "src1").alias("is_core"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def D9_D10_pending(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return upsert.pending(table(spark, sf_dir, "documents"), labels.filter("toxic = 1"), "doc_id", labels.filter("quality = 1")).select("doc_id", "lang")


@query("SELECT conv_id, string_agg(text, E'\\n' ORDER BY turn, role, text) AS full_text FROM conversations GROUP BY 1")
def A10_ordered_texts(spark, sf_dir):
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("full_text"))


@query("SELECT user_id, event_type, n, total FROM (SELECT user_id, event_type, count(*) AS n, CAST(round(sum(value) * 100) AS BIGINT) AS total FROM events GROUP BY ALL)")
def E5_event_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value") * 100).cast("long").alias("total"))


@query("SELECT lang, count(*) AS n, count(DISTINCT source) AS n_sources FROM documents GROUP BY 1")
def E13_distribution(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("n_sources"))


def _entities(events, condition: str):
    kept = events.filter(condition).groupBy("user_id")
    return kept.agg(F.min("event_type").alias("name"), F.count(F.lit(1)).alias("n_mentions"), F.max("value").alias("confidence"), (F.max((F.col("event_type") == "purchase").cast("int")) == 1).alias("is_tech_solution")).withColumn("id", F.col("user_id").cast("string")).drop("user_id")


def _entities_sql(condition: str) -> str:
    return f"SELECT CAST(user_id AS VARCHAR) AS id, min(event_type) AS name, count(*) AS n_mentions, max(value) AS confidence, bool_or(event_type = 'purchase') AS is_tech_solution FROM events WHERE {condition} GROUP BY user_id"


@query(f"SELECT coalesce(o.id, n.id) AS id, coalesce(o.name, n.name) AS name, greatest(o.n_mentions, n.n_mentions) AS n_mentions, greatest(o.confidence, n.confidence) AS confidence, coalesce(o.is_tech_solution, false) OR coalesce(n.is_tech_solution, false) AS is_tech_solution FROM ({_entities_sql('event_id % 3 = 0')}) o FULL JOIN ({_entities_sql('event_id % 3 <> 0 AND user_id > 5')}) n ON o.id = n.id")
def B7_upsert_entities(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return upsert.upsert_entities(_entities(events, "event_id % 3 = 0"), _entities(events, "event_id % 3 <> 0 AND user_id > 5")).select("id", "name", "n_mentions", "confidence", "is_tech_solution")


@query("SELECT doc_id, text_len, lang FROM (SELECT doc_id, length(text) AS text_len, 'xx' AS lang FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, length(text), lang FROM documents WHERE doc_id % 2 = 1)")
def B5_upsert_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("text_len"), "lang")
    return upsert.upsert_documents(docs, docs.filter("doc_id % 2 = 0").withColumn("lang", F.lit("xx")))


@query("SELECT CAST(vec_id AS VARCHAR) AS chunk_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label, round(embedding[1], 5) AS e1 FROM embeddings")
def B6_upsert_chunks(spark, sf_dir):
    old = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "label", "embedding")
    new = old.filter("chunk_id % 3 = 0").withColumn("label", F.col("label") + 100).withColumn("embedding", F.lit(None).cast("array<float>"))
    return upsert.upsert_chunks(old, new).select("chunk_id", "label", F.round(F.col("embedding")[0], 5).alias("e1"))


@query("SELECT s AS source_id, t AS target_id, greatest(a, b) AS n_evidence FROM (SELECT CAST(l_suppkey AS VARCHAR) AS s, CAST(l_partkey AS VARCHAR) AS t, count(*) FILTER (l_linenumber <= 3) AS a0, count(*) FILTER (l_linenumber > 3 AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12)) AS b0, CASE WHEN a0 > 0 THEN a0 END AS a, CASE WHEN b0 > 0 THEN b0 END AS b FROM lineitem GROUP BY l_suppkey, l_partkey) WHERE a IS NOT NULL OR b IS NOT NULL")
def B8_upsert_relations(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    half = lambda c: lines.filter(c).groupBy(F.col("l_suppkey").cast("string").alias("source_id"), F.col("l_partkey").cast("string").alias("target_id"), F.lit("USES_MATERIAL").alias("type")).agg(F.count(F.lit(1)).alias("n_evidence"), F.lit(0.5).alias("confidence"))
    ends = table(spark, sf_dir, "supplier").filter("s_nationkey < 12").select(F.col("s_suppkey").cast("string").alias("id")).unionByName(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"))).distinct()
    only = ends.join(table(spark, sf_dir, "supplier").filter("s_nationkey >= 12").select(F.col("s_suppkey").cast("string").alias("id")), "id", "left_anti")
    suppliers = table(spark, sf_dir, "supplier").filter("s_nationkey < 12").select(F.col("s_suppkey").cast("string").alias("source_id"))
    new = half("l_linenumber > 3").join(suppliers, "source_id", "left_semi")
    return upsert.upsert_relations(half("l_linenumber <= 3"), new, ends.unionByName(only).distinct()).select("source_id", "target_id", "n_evidence")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS id, max(l_quantity) AS value FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def B9_upsert_constraints(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("id"), F.col("l_orderkey").alias("chunk_id"), F.col("l_quantity").alias("value"), F.col("l_quantity").alias("ord"))
    chunks = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("chunk_id"))
    return upsert.upsert_constraints(lines.drop("ord").limit(0), lines, chunks, "ord").select("id", "value")


@query("SELECT DISTINCT l_partkey AS entity_id, l_orderkey AS chunk_id FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def B10_upsert_mentions(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("chunk_id"))
    parts = table(spark, sf_dir, "part").filter("p_size > 25").select(F.col("p_partkey").alias("id"))
    chunks = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("chunk_id"))
    return upsert.upsert_mentions(lines.limit(0), lines, parts, chunks)


@query("SELECT doc_id, CASE WHEN lang = 'de' THEN 'foreign' WHEN lang = 'fr' THEN 'global' ELSE 'old' END AS geography FROM documents")
def B11_update_geography(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    new = docs.select("doc_id", F.when(F.col("lang") == "de", "foreign").when(F.col("lang") == "fr", "global").otherwise("unknown").alias("geography"))
    return upsert.update_geography(docs.select("doc_id", F.lit("old").alias("geography")), new.unionByName(new.filter("doc_id = 1").select((F.col("doc_id") - 1000).alias("doc_id"), "geography")))


@query("SELECT p_partkey AS catalog_id, p_name AS title, CASE WHEN p_size < 10 THEN p_size + 1 ELSE p_size END AS n_files FROM part")
def B12_upsert_catalog(spark, sf_dir):
    old = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("catalog_id"), F.col("p_name").alias("title"), F.col("p_size").alias("n_files"))
    return upsert.merge(old, old.filter("n_files < 10").withColumn("n_files", F.col("n_files") + 1), ["catalog_id"], {})


@query("SELECT doc_id, code, reason FROM (SELECT doc_id, 'INGEST-002' AS code, length(text) || ' characters' AS reason FROM documents WHERE length(text) < 200)")
def B2_rejected(spark, sf_dir):
    error = F.when(F.length("text") < 200, F.struct(F.lit("INGEST-002").alias("code"), F.concat(F.length("text").cast("string"), F.lit(" characters")).alias("reason")))
    return upsert.split_failed(table(spark, sf_dir, "documents").select("doc_id", error.alias("error")))[1]


def _cos(a: str, b: str) -> str:
    return f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])))"


_QUESTION = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


def _question(spark, sf_dir) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").filter("vec_id = 0").first().embedding)


def _chunks(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % 50).cast("string").alias("doc_id"), "embedding")


def _labelled(chunks, spark, sf_dir):
    """Chunks of one label, as those that a graph query names."""
    return chunks.join(table(spark, sf_dir, "embeddings").filter("label = 3").select(F.col("vec_id").alias("chunk_id")), "chunk_id", "left_semi")


@query(f"SELECT vec_id, round({_cos('embedding', _QUESTION)}, 6) AS score FROM embeddings")
def C30_cosine(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vector.cosine(F.col("embedding"), vector.literal(_question(spark, sf_dir))), 6).alias("score"))


@query(f"SELECT vec_id AS chunk_id, round({_cos('embedding', _QUESTION)}, 6) AS score FROM embeddings ORDER BY 2 DESC, 1 LIMIT 8")
def K1_vector_search(spark, sf_dir):
    return vector.vector_search(_chunks(spark, sf_dir), _question(spark, sf_dir), 8).select("chunk_id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id AS chunk_id, round({_cos('embedding', _QUESTION)}, 6) AS score FROM embeddings WHERE label = 3")
def K3_rank_graph_chunks(spark, sf_dir):
    chunks, question = _chunks(spark, sf_dir), _question(spark, sf_dir)
    candidates = _labelled(chunks, spark, sf_dir).select("chunk_id", F.col("chunk_id").alias("ord"))
    return vector.rank_graph_chunks(candidates, vector.vector_search(chunks, question, 8), chunks, question).select("chunk_id", F.round("score", 6).alias("score"))


@query(f"""WITH s AS (SELECT vec_id AS chunk_id, {_cos('embedding', _QUESTION)} AS score FROM embeddings), v AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 8),
g AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM s WHERE chunk_id IN (SELECT vec_id FROM embeddings WHERE label = 3)),
b AS (SELECT chunk_id, min((CASE WHEN rank <= 7 THEN 0 ELSE 200000 END) + rank) AS k FROM g GROUP BY 1 UNION ALL SELECT chunk_id, 100000 + rank FROM v)
SELECT chunk_id, CAST(row_number() OVER (ORDER BY min(k)) AS INTEGER) AS position FROM b GROUP BY chunk_id QUALIFY position <= 12""")
def K4_quota_merge(spark, sf_dir):
    from pyspark.sql import Window as W

    chunks, question = _chunks(spark, sf_dir), _question(spark, sf_dir)
    hits = vector.vector_search(chunks, question, 8)
    ranked = lambda rows: rows.select("chunk_id", F.row_number().over(W.orderBy(F.desc("score"), "chunk_id")).alias("rank"))
    graph = vector.rank_graph_chunks(_labelled(chunks, spark, sf_dir).select("chunk_id", F.col("chunk_id").alias("ord")), hits, chunks, question)
    return vector.merge_with_quota(ranked(graph.orderBy(F.desc("score"), "ord").limit(12)), ranked(hits))


@query(f"""WITH s AS (SELECT vec_id AS chunk_id, CAST(vec_id % 50 AS VARCHAR) AS doc_id, {_cos('embedding', _QUESTION)} AS score FROM embeddings), pool AS (SELECT * FROM s ORDER BY score DESC, chunk_id LIMIT 40)
SELECT doc_id, chunk_id, round(score, 6) AS score FROM pool WHERE doc_id NOT IN ('0', '7') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk_id) = 1 ORDER BY 3 DESC, chunk_id LIMIT 3""")
def F2_similar_cases(spark, sf_dir):
    hits = vector.vector_search(_chunks(spark, sf_dir), _question(spark, sf_dir), 40)
    cited = spark.createDataFrame([("0",), ("7",)], "doc_id string")
    return vector.best_per_document(hits, cited, 3).select("doc_id", "chunk_id", F.round("score", 6).alias("score"))


@query("SELECT vec_id AS chunk_id FROM embeddings WHERE len(embedding) = 64")
def D20_one_dimension(spark, sf_dir):
    return vector.one_dimension(_chunks(spark, sf_dir), 64)[0].select("chunk_id")


def _extractions(spark, sf_dir):
    """Orders as extraction records: their parts are entities, a supplier is related to each of them."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    part = F.struct(F.col("p_name").alias("name"), F.lit("Material").alias("type"), F.array("p_type").alias("synonyms"), F.create_map(F.lit("brand"), F.col("p_brand")).alias("attrs"))
    maker = F.struct(F.concat(F.lit("Maker "), F.col("l_suppkey").cast("string")).alias("name"), F.lit("Process").alias("type"), F.array().cast("array<string>").alias("synonyms"), F.create_map().cast("map<string,string>").alias("attrs"))
    link = F.struct(maker["name"].alias("source"), F.col("p_name").alias("target"), F.lit("USES_MATERIAL").alias("type"), F.array().cast(f"array<{corpus.CONSTRAINT}>").alias("constraints"), F.round(1 - F.col("l_discount"), 2).alias("confidence"))
    by_line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    ordered = F.array_sort(F.collect_list(F.struct(by_line.alias("k"), part.alias("part"), maker.alias("maker"), link.alias("link"))), lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))
    rows = lines.groupBy("l_orderkey").agg(ordered.alias("l")).join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    flat = F.flatten(F.transform("l", lambda x: F.array(x["part"], x["maker"])))
    return rows.select(F.col("l_orderkey").alias("row_ord"), F.col("o_custkey").cast("string").alias("doc_id"), F.col("l_orderkey").cast("string").alias("chunk_id"), flat.alias("entities"), F.transform("l", lambda x: x["link"]).alias("relations"))


_SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"


@query(f"""WITH l AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
e AS (SELECT 'material:' || {_SLUG.format('p_name')} AS id, p_name AS name, k, o_custkey, l_orderkey FROM l UNION ALL SELECT 'process:maker-' || l_suppkey, 'Maker ' || l_suppkey, k, o_custkey, l_orderkey FROM l)
SELECT id, arg_min(name, k) AS name, count(*) AS n_mentions, arg_min(CAST(l_orderkey AS VARCHAR), k) AS chunk_id FROM e GROUP BY 1""")
def E6_entity_dedup(spark, sf_dir):
    rows = build.entity_rows(_extractions(spark, sf_dir), Thesaurus())
    geography = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("doc_id"), F.lit("ru").alias("geography"))
    return build.entities(rows, geography).select("id", "name", "n_mentions", "chunk_id")


@query(f"SELECT DISTINCT id AS entity_id, CAST(l_orderkey AS VARCHAR) AS chunk_id FROM (SELECT 'material:' || {_SLUG.format('p_name')} AS id, l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey UNION ALL SELECT 'process:maker-' || l_suppkey, l_orderkey FROM lineitem)")
def E7_mention_pairs(spark, sf_dir):
    return build.entity_rows(_extractions(spark, sf_dir), Thesaurus()).select(F.col("id").alias("entity_id"), "chunk_id").distinct()


@query(f"SELECT 'process:maker-' || l_suppkey AS source_id, 'material:' || {_SLUG.format('p_name')} AS target_id, count(*) AS n_evidence, max(round(1 - l_discount, 2)) AS confidence FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def D11_E8_relations(spark, sf_dir):
    extractions = _extractions(spark, sf_dir)
    rows = build.entity_rows(extractions, Thesaurus())
    return build.relations(build.relation_rows(extractions, rows)[0]).select("source_id", "target_id", "n_evidence", "confidence")


@query("""WITH p AS (SELECT DISTINCT l_partkey AS id, o_custkey AS doc_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey), g AS (SELECT id, CASE WHEN c_nationkey < 8 THEN 'ru' WHEN c_nationkey < 16 THEN 'foreign' WHEN c_nationkey < 20 THEN 'global' ELSE 'unknown' END AS geography FROM p LEFT JOIN customer ON c_custkey = doc_id),
c AS (SELECT id, geography, count(*) AS n FROM g GROUP BY ALL), t AS (SELECT *, max(n) OVER (PARTITION BY id) AS most FROM c)
SELECT id, CASE WHEN count(*) > 1 THEN 'unknown' ELSE min(geography) END AS geography FROM t WHERE n = most GROUP BY id""")
def E10_majority_geography(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("id"), F.col("o_custkey").alias("doc_id"))
    where = F.when(F.col("c_nationkey") < 8, "ru").when(F.col("c_nationkey") < 16, "foreign").when(F.col("c_nationkey") < 20, "global")
    return build.majority_geography(rows, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), where.alias("geography")))


@query("SELECT card, count(f) AS n_files FROM (SELECT DISTINCT p_brand AS card FROM part UNION SELECT DISTINCT p_brand || '/' || p_type FROM part WHERE p_size > 40) LEFT JOIN (SELECT p_partkey AS f, CASE WHEN EXISTS (SELECT 1 FROM part q WHERE q.p_size > 40 AND q.p_brand = p.p_brand AND q.p_type = p.p_type) THEN p_brand || '/' || p_type ELSE p_brand END AS c FROM part p) ON c = card GROUP BY 1")
def A12_cards(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    deep = F.concat_ws("/", "p_brand", "p_type")
    folders = part.select(F.col("p_brand").alias("card")).unionByName(part.filter("p_size > 40").select(deep.alias("card"))).distinct()
    return corpus.cards(part.select(F.concat_ws("/", "p_brand", "p_type", F.col("p_partkey").cast("string")).alias("path")), folders)


def _asked(spark, sf_dir):
    """The stated queries: every vector whose id is divisible by 20."""
    return table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))


_NEAREST = f"SELECT CAST(q.vec_id AS VARCHAR) AS question_id, c.vec_id AS chunk_id, round({_cos('q.embedding', 'c.embedding')}, 6) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {_cos('q.embedding', 'c.embedding')} DESC, c.vec_id) <= "


@query(_NEAREST + "1")
def K7_self_match(spark, sf_dir):
    """The nearest neighbour of a stored vector is the chunk itself, or an equal one before it."""
    return vector.search_many(_chunks(spark, sf_dir), _asked(spark, sf_dir), 1).withColumn("score", F.round("score", 6))


@query(_NEAREST + "5")
def B13_search_many(spark, sf_dir):
    return vector.search_many(_chunks(spark, sf_dir), _asked(spark, sf_dir), 5, block=20).withColumn("score", F.round("score", 6))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998")
def D19_between_years(spark, sf_dir):
    from lodestone.plans import answers

    return answers.between_years(table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year")), 1996, 1998)


@query("SELECT row_ord, key, node, n FROM (SELECT l_orderkey AS row_ord, lower(p_name) AS key, 'material:' || trim(regexp_replace(lower(arg_min(p_name, (l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice))), '[^a-z0-9]+', '-', 'g'), '-') AS node, 1::BIGINT AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, lower(p_name))")
def F5_endpoints(spark, sf_dir):
    rows = build.entity_rows(_extractions(spark, sf_dir), Thesaurus()).filter("type = 'Material'")
    return build.endpoints(rows)


@query("SELECT doc_id, n_chars, lang FROM documents WHERE lang = 'de'")
def A7_typed_jsonl(spark, sf_dir):
    """Written as JSON lines and read again with a fixed schema; a damaged line would fail the read."""
    path = session.scratch_path(spark, "jsonl")
    table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang").write.json(path)
    return spark.read.schema("doc_id long, n_chars long, lang string").option("mode", "FAILFAST").json(path).filter("lang = 'de'")


@query("SELECT p_partkey AS catalog_id, p_size + 1 AS n FROM part")
def B4_swap_in(spark, sf_dir):
    """A table rewritten from itself."""
    path = session.scratch_path(spark, "swap")
    table(spark, sf_dir, "part").select(F.col("p_partkey").alias("catalog_id"), F.col("p_size").alias("n")).write.parquet(path)
    upsert.swap_in(spark.read.parquet(path).withColumn("n", F.col("n") + 1), path)
    return spark.read.parquet(path)
