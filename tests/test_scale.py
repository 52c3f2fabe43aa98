"""Steps that must not grow faster than their tables: the same rows as the plain way, from few rows."""

import dataclasses
import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import terms
from lodestone.operators import build, graph as gr, vector
from lodestone.operators.graph import GraphTables
from lodestone.plans import gaps, projection, templates


@pytest.fixture(scope="module")
def g(spark):
    """40 materials, 30 processes with equal names and counts among them, few chunks and relations."""
    rng = random.Random(5)
    entities = [(f"material:{i}", "Material", f"ring {i % 7}", None, "ru", False, 0.9, rng.randrange(4)) for i in range(40)]
    entities += [(f"process:{i}", "Process", f"way {i % 9}", None, "ru", i % 5 > 0, 0.9, rng.randrange(4)) for i in range(30)]
    entities += [(f"expert:{i}", "Expert", f"person {i}", None, "ru", False, 0.9, 3) for i in range(6)]
    mentions = [(f"{kind}:{rng.randrange(n)}", f"c{rng.randrange(30)}") for kind, n in (("material", 40), ("process", 30), ("expert", 5)) for _ in range(90)]
    relations = [(f"process:{rng.randrange(30)}", f"material:{rng.randrange(40)}", rng.choice(["USES_MATERIAL", "CONTRADICTS"]), 0.5, 1, None, None) for _ in range(150)]
    relations += [(f"process:{i}", "material:0", "PRODUCES_OUTPUT", 0.5, 1, None, None) for i in range(30)]
    return GraphTables(
        spark.createDataFrame([(f"d{i}", f"title {i}", 2000 + i, ("ru", "foreign")[i % 2]) for i in range(10)], "doc_id string, title string, year int, geography string"),
        spark.createDataFrame([(f"c{i}", f"d{i % 10}") for i in range(30)], "chunk_id string, doc_id string"),
        spark.createDataFrame(entities, "id string, type string, name string, name_en string, geography string, is_tech_solution boolean, confidence double, n_mentions long"),
        spark.createDataFrame(relations, "source_id string, target_id string, type string, confidence double, n_evidence long, doc_id string, chunk_id string"),
        spark.createDataFrame(mentions, "entity_id string, chunk_id string"),
        spark.createDataFrame([(f"c{i}", "flow", "=", float(i), None, "l", "") for i in range(0, 30, 3)], "chunk_id string, param string, op string, norm_value double, value_max double, norm_unit string, source_text string"),
    )


TOPICS = {"first": [("ring 3", "way 2"), ("ring 1", "way 8")], "material_topics": ["ring 2", "ring 3"], "process_topics": ["way 1", "way 2", "way 4"]}


@pytest.mark.parametrize("topics", [{}, TOPICS])
def test_first_gaps_equal_those_of_the_whole_matrix(g, topics):
    whole = templates.gap_matrix(g, ["ring"], ["way"], None)
    rows, order = gaps.ordered_cells(whole, **topics)
    n_all, plain = whole.count(), lambda df: [tuple(r) for r in df.select("material_id", "process_id", "n_sources", "chunk_ids").collect()]
    for most in (0, 1, 3, 25):
        some, same = gaps.first_cells(g, ["ring"], ["way"], limit=most, **topics)
        assert some.count() < n_all and plain(some.orderBy(*same).limit(most)) == plain(rows.orderBy(*order).limit(most))
    some, same = gaps.first_cells(g, ["ring"], ["way"], per_material=2, **topics)
    assert some.count() < n_all and sorted(plain(gaps.cap_per_material(some, same, 2))) == sorted(plain(gaps.cap_per_material(rows, order, 2)))


def test_the_gap_matrix_with_a_limit_and_its_totals(g):
    whole = templates.gap_matrix(g, ["ring"], ["way"], None)
    order = [F.desc("n_sources"), "material_name", "process_name", "material_id", "process_id"]
    for most in (1, 40, 200):
        found = templates.gap_matrix(g, ["ring"], ["way"], most)
        assert [tuple(r) for r in found.collect()] == [tuple(r) for r in whole.orderBy(*order).limit(most).select(found.columns).collect()]
    counts = whole.groupBy("material_id").agg(F.count(F.lit(1)).alias("n_gaps"), F.count_if(F.col("n_sources") == 0).alias("n_unseen"), F.max("n_sources").alias("most"))
    assert sorted(map(tuple, templates.gap_totals(g, *templates.gap_lists(g, ["ring"], ["way"])).collect())) == sorted(map(tuple, counts.collect()))


def test_search_of_many_sends_no_question_through_the_driver(spark):
    """Copies of a vector have equal scores in any block, and ties go by the chunk's id."""
    rng = random.Random(8)
    some = [[rng.gauss(0, 1) for _ in range(24)] for _ in range(7)]
    chunks = spark.createDataFrame([(i, some[i % 7]) for i in range(9000)], "chunk_id long, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(f"q{i}", some[i % 7]) for i in range(50)], "question_id string, vector array<float>")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    found = vector.search_many(chunks, asked, 3, block=8)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before
    got = sorted((int(r.question_id[1:]), -r.score, r.chunk_id) for r in found.collect())
    assert [(q, c) for q, _, c in got] == [(q, q % 7 + 7 * k) for q in range(50) for k in range(3)]


def test_documents_are_counted_as_their_sets_are(g):
    nodes = g.of_type("Material", "Process")
    sets = {r.id: (len(r.doc_ids), r.doc_geographies) for r in gr.document_sets(g, nodes).collect()}
    assert {r.id: (r.n_docs, r.doc_geographies) for r in gr.document_counts(g, nodes, "Material", "Process").collect()} == sets


@pytest.mark.parametrize("year,limit", [(None, None), (None, 1), (2006, None)])
def test_chunks_of_a_topic_are_those_of_its_rows(g, year, limit):
    some = dataclasses.replace(g, entities=g.entities.withColumn("type", F.when(F.col("type") == "Expert", "Experiment").otherwise(F.col("type"))))
    found = templates.execute(some, "experiments_publications_by_topic", material_terms=["ring 1", "ring 2"], year=year, limit=limit)
    want = {c for r in found["rows"].collect() for c in r.chunk_ids}
    assert want and sorted(r.chunk_id for r in found["chunk_ids"].collect()) == sorted(want)


def test_processes_by_a_shared_chunk_without_a_limit(g):
    met = {r.b for r in gr.co_mentions(g.mentions, gr.named(g.of_type("Material"), ["ring 1"]), g.of_type("Process")).collect()}
    want = met | {r.id for r in gr.named(g.of_type("Process"), ["way 3"]).collect()}
    assert sorted(r.node_id for r in templates.mine_water_injection(g, ["way 3"], ["ring 1"], limit=None).collect()) == sorted(want)


def test_every_expert_without_a_limit(spark, g):
    found = templates.recommendation_expert(g, g.chunks, projection.frame(spark, "doc_id", []), projection.frame(spark, "id", []), None)
    docs = {r.id: len(r.doc_ids) for r in gr.document_sets(g, g.of_type("Expert")).collect()}
    assert docs and {r.id: r.n_matched_sources for r in found.collect()} == docs


def test_context_of_all_chunks_is_that_of_each(g):
    plain = lambda rows: sorted(map(repr, rows.collect()))
    assert plain(templates.gap_cell_context(g, None)) == plain(templates.gap_cell_context(g, g.chunks))


def test_plans_know_that_a_few_ids_are_few(spark):
    for values in ([], ["a", "b"]):
        rows = projection.frame(spark, "id", values)
        assert [r.id for r in rows.collect()] == values
        assert int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 1000


def test_relations_to_names_that_are_given(spark):
    records = spark.sql("SELECT 1 AS row_ord, 'd' AS doc_id, 'c' AS chunk_id, array(named_struct('name', 'a'), named_struct('name', 'b')) AS entities, array(named_struct('source', 'a', 'target', 'b', 'type', 'T')) AS relations")
    kept = lambda names: [r.kept for r in build.marked_relations(records, terms.Thesaurus(), names).collect()]
    assert kept(None) == [True] and kept(spark.sql("SELECT 1 AS row_ord, 'a' AS name")) == [False]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data here")
def test_types_not_asked_for_are_not_read(spark):
    g = projection.project(spark, "/root/testdata/sf0.001")
    optimized = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert optimized(g.mentions_of("Process")) == 1
    assert optimized(g.of_type("Expert").select("id", "name")) == 1 and optimized(g.of_type("Expert")) == 2
