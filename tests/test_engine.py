"""Every registered query against its SQL on the smallest tables, and golden cases of the functions."""

import glob
import os
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from lodestone import session
from lodestone.functions import chunking, constraints, terms, text
from lodestone.operators import upsert, vector
from lodestone.plans import gaps, registry, templates
from lodestone.sources import corpus
from lodestone.streaming import ingest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@needs_data
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


def test_slugs_names_and_languages(spark):
    rows = {"Reverse Osmosis": "reverse-osmosis", "медь": "med", "щёлочь": "scheloch", "Cu/Ni-сплав!!!": "cu-ni-splav"}
    for given, want in rows.items():
        assert one(spark, text.slug(F.col("t")), t=given) == want
    odd = [one(spark, text.slug(F.col("t")), t=t) for t in ("", "!!!")]
    assert all(len(x) == 12 for x in odd) and odd[0] != odd[1]
    assert [one(spark, text.detect_lang(F.col("t")), t=t) for t in ("вода", "water", "вода ab", "12")] == ["ru", "en", "mixed", "ru"]
    pick = lambda name, pool: spark.range(1).select(text.other_script_name(F.lit(name), F.array(*map(F.lit, pool)))).first()[0]
    assert (pick("никель", ["Ni", "nickel"]), pick("nickel", ["Ni", "никель"]), pick("никель", ["медь"])) == ("Ni", "никель", "")


def test_whitespace_quotes_and_numbers(spark):
    assert one(spark, text.clean_whitespace(F.col("t")), t="  a \t b \r\n\n\n\n c  \n") == "a b\n\nc"
    assert one(spark, text.quote(F.col("t"), 10), t="  aaaa bbbb cccc") == "aaaa bbbb…"
    assert one(spark, text.parse_number(F.col("t")), t="1 234 567,5") == 1234567.5
    assert one(spark, text.year(F.lit("a_1999_2010"), F.lit(None), F.lit(""), 2026), t="") == 2010
    assert one(spark, text.strip_fences(F.col("t")), t="```json\n{}\n```") == "{}"
    assert one(spark, text.strip_think(F.col("t")), t="<think>x\ny</think> a") == "a"


GOLDEN = [
    ("требуемый сухой остаток — ≤1000 мг/дм³", ("сухой остаток", "<=", 1000.0, None, "мг/дм³", 1000.0, "мг/л")),
    ("реагент 1,5 г/л", ("", "=", 1.5, None, "г/л", 1500.0, "мг/л")),
    ("температура не ниже 60 °C", ("температура", ">=", 60.0, None, "°C", 60.0, "°C")),
    ("температура не выше 60 °C", ("температура", "<=", 60.0, None, "°C", 60.0, "°C")),
    ("температура ниже 60 °C", ("температура", "<", 60.0, None, "°C", 60.0, "°C")),
    ("температура выше 60 °C", ("температура", ">", 60.0, None, "°C", 60.0, "°C")),
    ("влажность 5%", ("влажность", "=", 5.0, None, "%", 5.0, "%")),
    ("расход свыше 200 м³/ч", ("расход", ">", 200.0, None, "м³/ч", 200.0, "м³/ч")),
    ("сульфаты по 200–300 мг/л", ("сульфаты", "range", 200.0, 300.0, "мг/л", 200.0, "мг/л")),
    ("содержание никеля от 1 до 2 %", ("содержание никеля", "range", 1.0, 2.0, "%", 1.0, "%")),
]


@pytest.mark.parametrize("sentence,want", GOLDEN)
def test_constraints(sentence, want):
    (c,) = constraints.extract(sentence)
    assert (c.param, c.op, c.value, c.value_max, c.unit, c.norm_value, c.norm_unit) == want


def test_constraints_without_units():
    assert constraints.extract("в 2020 году") == constraints.extract("") == constraints.extract(None) == []


QUESTIONS = [
    ("Какие методы обессоливания воды подходят, если вода содержит сульфаты, хлориды по 200–300 мг/л, а сухой остаток — ≤1000 мг/дм³?", "desalination_methods"),
    ("Какие решения организации циркуляции католита при электроэкстракции никеля описаны в мировой практике?", "catholyte_circulation"),
    ("Покажите все эксперименты по распределению Au, Ag и МПГ между штейном и шлаком за последние 5 лет.", "experiments_publications_by_topic"),
    ("Какие способы закачки шахтных вод в глубокие горизонты применялись в России и за рубежом?", "mine_water_injection"),
    ("Сколько стоит обед?", "rag_fallback"),
]


@pytest.mark.parametrize("question,template", QUESTIONS)
def test_routing(question, template):
    intent = terms.route(question, today=date(2026, 7, 1))
    assert intent.template == template
    if template == "desalination_methods":
        assert [c.op for c in intent.numeric] == ["range", "<="] and intent.slots["process"] == "обессоливание"
    if template == "experiments_publications_by_topic":
        assert (intent.year_from, intent.year_to, intent.slots) == (2022, None, {"material": "штейн"})
    if template in ("catholyte_circulation", "mine_water_injection"):
        assert intent.compare_geography
    if template != "rag_fallback":
        assert terms.parameters(intent, terms.Thesaurus())


def test_thesaurus():
    t = terms.Thesaurus()
    assert t.canonical(" Reverse Osmosis ") == "обратный осмос" and t.canonical("nothing") is None
    assert t.expand("RO") == ["reverse osmosis", "ro", "гиперфильтрация", "обратный осмос"] and "ro" not in t.expand("RO", 3)
    with pytest.raises(ValueError, match="GRAPH-003"):
        terms.Thesaurus([("x", "Planet", ())])


def test_chunks_cover_sentences_and_overlap(spark):
    whole = " ".join(f"Sentence number {i} says little." for i in range(200))
    found = chunking.chunks_of(whole, 300, 60)
    assert all(whole[a:b] == t and b - a <= 300 for _, t, a, b in found)
    assert all(b - a2 >= 60 for (_, _, _, b), (_, _, a2, _) in zip(found, found[1:]))
    assert chunking.pack([(0, 10), (10, 900), (900, 910)], 100, 50) == [(0, 10), (10, 900), (900, 910)]
    assert chunking.chunks_of("") == [] and chunking.sentence_spans("a. b") == [(0, 2), (2, 4)]
    rows = chunking.chunk_table(spark.createDataFrame([("d", whole), ("e", None), ("f", " ")], "doc_id string, text string")).collect()
    assert {r.doc_id for r in rows} == {"d"} and rows[0].chunk_id == "d#0"


def test_boilerplate(spark):
    docs = {"a": [f"Journal 2020\nbody {i}\n{i}" for i in range(6)], "b": ["a\nb", "c\nd", "e\nf"], "c": ["Head\nx"] * 2, "d": ["Head 1\nx\n\n", None, " HEAD  22\ny", "head 3"]}
    rows = [(d, n, t) for d, pages in docs.items() for n, t in enumerate(pages)]
    got = {r.doc_id: r.text for r in chunking.without_boilerplate(spark.createDataFrame(rows, "doc_id string, page int, text string")).collect()}
    assert got == {"a": "\n".join(f"body {i}" for i in range(6)), "b": "a\nb\nc\nd\ne\nf", "c": "Head\nx\nHead\nx", "d": "x\n\ny\n"}


def test_cosine_edges(spark):
    cases = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 0.0], [-1.0, 0.0], -1.0), ([1.0], [1.0, 0.0], -1.0), ([0.0, 0.0], [1.0, 0.0], -1.0), (None, [1.0], -1.0)]
    got = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a array<double>, b array<double>").select("i", vector.cosine(F.col("a"), F.col("b")).alias("c")).orderBy("i").collect()
    assert [round(r.c, 9) for r in got] == [c for _, _, c in cases]


def test_quota_merge(spark):
    rank = lambda ids: spark.createDataFrame([(c, i + 1) for i, c in enumerate(ids)], "chunk_id string, rank int")
    merged = lambda g, v: [r.chunk_id for r in vector.merge_with_quota(rank(g), rank(v)).orderBy("position").collect()]
    g, v = [f"g{i}" for i in range(10)], [f"v{i}" for i in range(5)]
    assert merged(g, v) == g[:7] + v
    assert merged(g, ["v0"]) == g[:7] + ["v0"] + g[7:]
    assert merged(["g0"], ["g0", *v]) == ["g0", *v]


def test_upsert_twice_changes_nothing(spark):
    schema = "id string, name string, n_mentions long, confidence double, is_tech_solution boolean"
    old = spark.createDataFrame([("a", "A", 5, 0.9, True), ("b", "B", 1, 0.5, False)], schema)
    new = spark.createDataFrame([("a", "other", 2, 0.7, False), ("c", "C", 1, 0.1, False)], schema)
    once = upsert.upsert_entities(old, new)
    rows = sorted(map(tuple, once.collect()))
    assert rows == [("a", "A", 5, 0.9, True), ("b", "B", 1, 0.5, False), ("c", "C", 1, 0.1, False)]
    assert sorted(map(tuple, upsert.upsert_entities(once, new).collect())) == rows


def test_swap_and_stream(spark, tmp_path):
    schema = "id string, name string, n_mentions long, confidence double, is_tech_solution boolean"
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    for rows in ([("a", "A", 5, 0.9, True)], [("a", "X", 3, 0.95, False), ("b", "B", 1, 0.5, False)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        ingest.merge_stream(spark, source, schema, table, str(tmp_path / "state"))
    assert sorted(map(tuple, spark.read.parquet(table).collect())) == [("a", "A", 5, 0.95, True), ("b", "B", 1, 0.5, False)]
    assert not glob.glob(f"{table}.new")


def test_one_row_of_each_key_after_a_merge(spark):
    schema = "id string, name string, n_mentions long, confidence double, is_tech_solution boolean"
    old = spark.createDataFrame([("a", "A", 1, 0.1, False)], schema)
    new = spark.createDataFrame([("a", "x", 2, 0.9, False), ("a", "y", 7, 0.2, True), ("b", "p", 3, 0.3, False), ("b", "q", 1, 0.5, False)], schema)
    rows = sorted(map(tuple, upsert.upsert_entities(old, new).collect()))
    assert rows == [("a", "A", 7, 0.9, True), ("b", "q", 3, 0.5, False)]
    chunks = "chunk_id string, text string, embedding array<float>"
    twice = spark.createDataFrame([("c", "one", None), ("c", "two", [1.0])], chunks)
    assert [r.text for r in upsert.upsert_chunks(spark.createDataFrame([], chunks), twice).collect()] == ["two"]
    docs = spark.createDataFrame([("d", 1), ("d", 2)], "doc_id string, year int")
    assert [tuple(r) for r in upsert.upsert_documents(spark.createDataFrame([("d", 0), ("e", 5)], docs.schema), docs).orderBy("doc_id").collect()] == [("d", 2), ("e", 5)]


def test_a_swap_that_broke_off(spark, tmp_path):
    path = str(tmp_path / "t")
    upsert.swap_in(spark.range(3), path)
    session.move(spark, path, f"{path}.old")  # as if the process had ended between the two renames
    upsert.recovered(spark, path)
    assert spark.read.parquet(path).count() == 3
    upsert.swap_in(spark.read.parquet(path).filter("id > 0"), path)
    assert spark.read.parquet(path).count() == 2 and not glob.glob(f"{path}.*")
    with pytest.raises(OSError):
        session.move(spark, str(tmp_path / "nothing"), path)


def test_search_of_many_questions_equals_one_by_one(spark):
    rng = random.Random(3)
    vec = lambda: [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)]
    chunks = spark.createDataFrame([(f"c{i:02d}", vec()) for i in range(40)] + [("x", None), ("y", [0.0] * 4), ("z", [1.0])], "chunk_id string, embedding array<double>").repartition(3)
    asked = [(f"q{i}", vec()) for i in range(7)] + [("other", [2.0]), ("zero", [0.0] * 4)]
    got = {}
    for r in vector.search_many(chunks, spark.createDataFrame(asked, "question_id string, vector array<double>"), 3, block=2).collect():
        got.setdefault(r.question_id, []).append((round(r.score, 9), r.chunk_id))
    assert set(got) == {q for q, v in asked if any(v)}
    for q, v in asked[:7]:
        if any(v):
            want = [round(r.score, 9) for r in vector.vector_search(chunks.filter("chunk_id not in ('x', 'y', 'z')"), v, 3).collect()]
            assert sorted((s for s, _ in got[q]), reverse=True) == want
    assert got["other"] == [(1.0, "z")]
    assert vector.search_many(chunks, spark.createDataFrame([], "question_id string, vector array<double>"), 3).count() == 0


def test_search_with_a_block_of_no_questions(spark):
    """Equal names fall into one block, so the other two are empty."""
    chunks = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0])], "chunk_id string, embedding array<double>")
    asked = spark.createDataFrame([("q", [0.0, 1.0])] * 3, "question_id string, vector array<double>")
    found = vector.search_many(chunks, asked, 1, block=1).collect()
    assert {(r.question_id, r.chunk_id, r.score) for r in found} == {("q", "b", 1.0)}


def test_bad_geography_is_an_error(spark):
    docs = spark.createDataFrame([("d", "unknown")], "doc_id string, geography string")
    with pytest.raises(Exception, match="GRAPH-006"):
        upsert.update_geography(docs, spark.createDataFrame([("d", "mars")], docs.schema)).collect()


def test_refusals(spark):
    with pytest.raises(ValueError):
        templates.gap_matrix(None, [], [])
    with pytest.raises(ValueError, match="SEARCH-008"):
        templates.execute(None, "nothing")
    with pytest.raises(ValueError, match="ANALYTICS-002"):
        gaps.gap_cells(None, ["a"], ["b"], -1)


def test_office_files(spark, tmp_path):
    import zipfile

    folder = tmp_path / "corpus" / "Papers"
    folder.mkdir(parents=True)
    word = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>Line {i} of the text.</w:t></w:r></w:p>" for i in range(30))
    with zipfile.ZipFile(folder / "a_report_2015.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{word}"><w:body>{body}<w:p/></w:body></w:document>')
        z.writestr("docProps/core.xml", '<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>Document</dc:title><dc:creator>A; B</dc:creator></c>')
    slide = "http://schemas.openxmlformats.org/drawingml/2006/main"
    with zipfile.ZipFile(folder / "b.pptx", "w") as z:
        z.writestr("ppt/slides/slide1.xml", f'<s xmlns:a="{slide}"><a:p><a:r><a:t>Short</a:t></a:r></a:p></s>')
    (folder / "c.docx").write_bytes(b"broken")
    (folder / ".hidden.docx").write_bytes(b"x")
    found = corpus.files(spark, str(tmp_path / "corpus"), ("Papers",))
    rows = {r.path: r for r in corpus.documents(found, 2026).collect()}
    good = rows["Papers/a_report_2015.docx"]
    assert (good.title, good.authors, good.year, good.lang, good.error) == ("a report 2015", ["A", "B"], 2015, "en", None)
    assert rows["Papers/b.pptx"].error.code == "INGEST-002" and rows["Papers/c.docx"].error.code == "INGEST-001" and len(rows) == 3


def test_injected_backends_and_pages(spark, tmp_path):
    folder = tmp_path / "corpus" / "Papers"
    folder.mkdir(parents=True)
    for name in ("a_2001.pdf", "b.pdf", "c.doc"):
        (folder / name).write_bytes(name.encode())

    def pages(content):
        if content.startswith(b"b"):
            raise ValueError("encrypted")
        return [f"Journal of Water {k}\nThis is the body of page number {k}, which says enough to be kept as a text of its own.\n{k}" for k in range(1, 6)], "Document", "A, B", "D:20030405"

    found = corpus.files(spark, str(tmp_path / "corpus"), ("Papers",))
    rows = {r.path: r for r in corpus.documents(found, 2026, backends={".pdf": pages, ".doc": corpus.legacy_word("no-such-program")}).collect()}
    good = rows["Papers/a_2001.pdf"]
    assert "Journal" not in good.text and good.text.count("body of page") == 5 and (good.title, good.authors, good.year) == ("a 2001", ["A", "B"], 2001)
    assert rows["Papers/b.pdf"].error.code == "INGEST-001" and "encrypted" in rows["Papers/b.pdf"].error.reason
    assert rows["Papers/c.doc"].error.code == "INGEST-001"


def test_limit_by_the_order_of_lines(spark, tmp_path):
    for name, first in (("a", 0), ("b", 5000)):
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"doc_id": "{first + k}", "text": "{"x" * (k % 50)}", "n_chars": 1}}\n' for k in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # several parts a file
    try:
        got = [int(r.doc_id) for r in corpus.read_jsonl(spark, str(tmp_path), "texts", limit=5003).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(got) == list(range(5003))


def test_jsonl(spark, tmp_path):
    path = tmp_path / "chunks.jsonl"
    path.write_text('{"chunk_id": "a#0", "doc_id": "a", "text": "x", "start": 0, "end": 1, "lang": "en"}\n{"chunk_id": "b#0", "doc_id": "b"}\nbroken\n')
    assert corpus.read_jsonl(spark, str(path), "chunks", strict=False).filter("chunk_id is not null").count() == 2
    with pytest.raises(Exception):
        corpus.read_jsonl(spark, str(path), "chunks").collect()
