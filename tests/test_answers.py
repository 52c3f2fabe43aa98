import dataclasses

import pytest
from pyspark.sql import functions as F

from lodestone.functions import terms
from lodestone.functions.terms import Thesaurus
from lodestone.operators import build, providers
from lodestone.operators.graph import GraphTables
from lodestone.plans import answers, gaps
from lodestone.sources import catalog


def graph(spark):
    chunks = spark.createDataFrame([(f"d{i // 2}#{i % 2}", f"d{i // 2}", t) for i, t in enumerate(["Обратный осмос снижает минерализацию. Это проверено.", "Шлак и штейн.", "Электродиализ дорог.", "Прочее. Текст."])], "chunk_id string, doc_id string, text string")
    chunks = providers.embedded(chunks).drop("error")
    documents = spark.createDataFrame([("d0", "First", 2020, "ru"), ("d1", "Second", None, "foreign")], "doc_id string, title string, year int, geography string")
    entities = spark.createDataFrame([("process:a", "Process", "обратный осмос", "", "ru", True, 0.9, 3), ("process:b", "Process", "электродиализ", "", "ru", False, 0.9, 1)], "id string, type string, name string, name_en string, geography string, is_tech_solution boolean, confidence double, n_mentions long")
    relations = spark.createDataFrame([("process:a", "process:b", "CONTRADICTS", 0.8, 1, "d1", "d1#0")], "source_id string, target_id string, type string, confidence double, n_evidence long, doc_id string, chunk_id string")
    mentions = spark.createDataFrame([("process:a", "d0#0"), ("process:b", "d1#0")], "entity_id string, chunk_id string")
    constraints = spark.createDataFrame([], "id string, chunk_id string, param string, op string, norm_value double, value_max double, norm_unit string, source_text string")
    return GraphTables(documents, chunks, entities, relations, mentions, constraints)


def test_answer_with_graph_evidence(spark):
    g = graph(spark)
    a = answers.answer(g, "Что известно про обратный осмос?", providers.hashed_words)
    assert a.found and a.node_ids == ["process:a"] and a.citations[0].chunk_id == "d0#0"
    both = answers.answer(g, "Методы опреснения воды", providers.hashed_words)
    assert both.contradictions[0][:2] == ("обратный осмос", "электродиализ") and both.contradictions[0][2].quote == "Электродиализ дорог."
    page = answers.answer_markdown(both)
    assert "## Источники" in page and "**противоречит**" in page and "First (2020)" in page


def test_fallbacks(spark):
    g = graph(spark)
    failing = lambda question, context: 1 / 0
    a = answers.answer(g, "Что угодно", providers.hashed_words, synthesise=failing, top_k=2)
    assert a.found and len(a.citations) == 2 and a.text.startswith("[1] ")
    assert answers.answer(g, "Что угодно", providers.hashed_words, synthesise=lambda q, c: "готово").text == "готово"
    none = GraphTables(g.documents, g.chunks.limit(0), *(getattr(g, n) for n in ("entities", "relations", "mentions", "constraints")))
    assert not answers.answer(none, "Что угодно", providers.hashed_words).found


def test_one_side_of_the_evidence_may_fail(spark):
    g = graph(spark)
    intent = terms.route("Методы опреснения воды")

    def broken(*_, **__):
        raise RuntimeError("no graph today")

    alone = answers.evidence(g, intent, Thesaurus(), providers.hashed_words(["вода"])[0], 2, execute=broken)
    assert alone["chunks"].count() == 2 and alone["node_ids"] is None and alone["contradictions"] is None
    graph_only = answers.answer(g, "Методы опреснения воды", broken)
    assert graph_only.found and {c.chunk_id for c in graph_only.citations} == {"d0#0", "d1#0"}
    assert not answers.answer(g, "Сколько стоит обед?", broken).found


def test_recommendations_tolerate_a_failed_branch(spark):
    g = graph(spark)
    experts = spark.createDataFrame([("expert:1", "Expert", "A. Ivanov", "", "ru", False, 0.9, 2), ("expert:2", "Expert", "Ivanov A", "", "ru", False, 0.9, 1), ("property:x", "Property", "x", "", "ru", False, 0.9, 9)], g.entities.schema)
    g = dataclasses.replace(g, entities=g.entities.unionByName(experts), mentions=g.mentions.unionByName(spark.createDataFrame([("expert:1", "d0#0"), ("expert:2", "d0#0"), ("property:x", "d0#0")], g.mentions.schema)))
    cited, nodes = spark.createDataFrame([("d0#0", "d0")], "chunk_id string, doc_id string"), spark.createDataFrame([("process:a",)], "id string")
    whole = gaps.recommendations(g, providers.hashed_words(["Прочее. Текст."])[0], cited, nodes)
    rows = [(r.kind, [x.id for x in r["items"]]) for r in gaps.grouped(whole).collect()]
    assert rows == [("similar_case", ["d1"]), ("expert", ["expert:1"]), ("adjacent_topic", ["property:x", "process:b", "expert:1"])]

    def service():
        raise RuntimeError("refused")

    assert [r.kind for r in gaps.grouped(gaps.recommendations(g, service, cited, nodes)).collect()] == ["expert", "adjacent_topic"]
    broken = dataclasses.replace(g, relations=spark.createDataFrame([("a",)], "source_id string"))
    assert [r.kind for r in gaps.grouped(gaps.recommendations(broken, providers.hashed_words(["a"])[0], cited, nodes)).collect()] == ["similar_case"]
    with pytest.raises(ValueError, match="ANALYTICS-002"):
        gaps.recommendations(g, None, cited, nodes, -1)


def test_embedding_isolates_bad_texts(spark):
    def service(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("refused")
        return [[1.0, 2.0] for _ in texts]

    rows = spark.createDataFrame([("a", "fine"), ("b", "bad"), ("c", None)], "chunk_id string, text string")
    got = {r.chunk_id: r for r in providers.embedded(rows, service).collect()}
    assert got["a"].embedding == [1.0, 2.0] and got["a"].error is None and got["c"].error is None
    assert got["b"].embedding is None and got["b"].error.code == "SEARCH-003"


def test_views(spark):
    rows = spark.createDataFrame([(1, 1990), (2, None), (3, 2010)], "i int, year int")
    assert [r.i for r in answers.between_years(rows, 2000, None).orderBy("i").collect()] == [2, 3]
    nodes = spark.createDataFrame([("a", "Material"), ("b", "Expert"), ("c", "Material")], "id string, type string")
    edges = spark.createDataFrame([("a", "c", "USES_MATERIAL", 0.2), ("c", "a", "CONTRADICTS", 0.1), ("a", "b", "USES_MATERIAL", 0.9)], "source string, target string, type string, confidence double")
    kept = answers.shown_nodes(nodes, ["Material"])
    assert [r.type for r in answers.shown_edges(edges, kept, 0.5).collect()] == ["CONTRADICTS"]
    assert "| a | b | — | 0 | **да** |" in answers.gap_markdown([{"material": "a", "process": "b", "n_sources": 0}], ["тема"])
    assert answers.context_block([{"title": "T", "year": 2001, "text": " x "}]) == "[Фрагмент 1] (T, 2001):\nx"


def test_cache(tmp_path):
    cache = answers.AnswerCache(str(tmp_path / "answers.json"))
    assert cache.get("Что  это?") is None
    cache.put("Что  это?", "ответ")
    assert cache.get(" что это ") == "ответ"


def test_catalog_cards(spark):
    paths = ["Журналы/Цветные металлы/2019/март/a.pdf", "Журналы/Цветные металлы/2020/b.pdf", "Журналы/Цветные металлы/Приложение/c 1999.pdf", "Материалы конференций/x.pdf", "Материалы конференций/Источники данных о никеле/LME/2021/d.pdf"]
    got = {r.path: r for r in catalog.entries(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    metals = got["Журналы/Цветные металлы"]
    assert (metals.title, metals.kind, metals.year_from, metals.year_to, metals.n_files) == ("Журнал «Цветные металлы»", "journal", 2019, 2020, 2)
    assert "выпуски 2019–2020, 2 файла" in metals.description
    market = got["Материалы конференций/Источники данных о никеле/LME"]
    assert (market.title, market.kind) == ("Рыночная аналитика никеле: LME", "market_analytics")
    assert got["Материалы конференций"].title == "Материалы конференций: отдельные документы"


def test_records_are_merged_and_filtered(spark):
    from lodestone.sources.corpus import CONSTRAINT

    entity = "array<struct<name:string,type:string,synonyms:array<string>,attrs:map<string,string>>>"
    rows = spark.createDataFrame(
        [(0, "d", "d#0", [("хвосты", "Material", ["t"], {"k": "1"}), ("Хвосты", "Process", [], {}), ("RO", "Process", ["x"], {"a": "1"}), ("обратный осмос", "Process", [], {"a": "2"})], [("хвосты", "ro", "USES_MATERIAL", [], 0.5), ("хвосты", "ghost", "USES_MATERIAL", [], 0.5)], [])],
        f"row_ord long, doc_id string, chunk_id string, entities {entity}, relations array<struct<source:string,target:string,type:string,constraints:array<{CONSTRAINT}>,confidence:double>>, constraints array<{CONSTRAINT}>",
    )
    t = Thesaurus()
    merged = {r.name: r for r in build.merged_in_chunk(rows, t).collect()}
    assert merged["обратный осмос"].synonyms == ["x", "RO"] and merged["обратный осмос"].attrs == {"a": "2"}
    good, dropped = build.kept_relations(rows, t)
    assert [(r.source, r.target) for r in good.collect()] == [("хвосты", "обратный осмос")] and dropped.count() == 1
    nodes = build.entity_rows(rows, t)
    found, missing, ambiguous = build.relation_rows(rows, nodes)
    assert [r.source_id for r in found.collect()] == ["material:hvosty"] and missing.count() == 1 and ambiguous.count() >= 1
    made = {r.id: r for r in build.with_solutions(build.entities(nodes, spark.createDataFrame([("d", "ru")], "doc_id string, geography string")), build.relations(found)).collect()}
    assert made["material:hvosty"].synonyms == ["t", "хвосты"] and made["process:obratnyy-osmos" if "process:obratnyy-osmos" in made else "process:obratnyi-osmos"].n_mentions == 2
    assert made["material:hvosty"].geography == "ru" and not made["material:hvosty"].is_tech_solution
    assert build.constraint_rows(rows).count() == 0 and F is not None
