"""Runs over a corpus: outputs, side outputs, resuming, and the codes of what fails."""

import json
import zipfile

from pyspark.sql import functions as F

from lodestone import __main__ as cli
from lodestone.plans import runs


def test_corpus_run_overwrites_its_outputs(spark, tmp_path, capsys):
    folder = tmp_path / "corpus" / "Papers"
    folder.mkdir(parents=True)
    word = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>Line {i} of the text.</w:t></w:r></w:p>" for i in range(200))
    with zipfile.ZipFile(folder / "report_2015.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{word}"><w:body>{body}</w:body></w:document>')
    (folder / "broken.docx").write_bytes(b"no")
    for _ in range(2):
        out = runs.corpus_run(spark, str(tmp_path / "corpus"), ("Papers",), str(tmp_path / "out"), this_year=2026)
    assert {k: v.count() for k, v in out.items() if k != "chunks"} == {"documents": 1, "texts": 1, "skipped": 1} and out["chunks"].count() > 1
    assert out["skipped"].first().code == "INGEST-001" and out["documents"].first().year == 2015
    whole = runs.whole_texts(out["chunks"]).first()
    assert whole.doc_id == out["documents"].first().doc_id and whole.text.startswith("Line 0") and "Line 199" in whole.text
    assert cli.main(["ingest", str(tmp_path / "corpus"), str(tmp_path / "out2"), "--core", "Papers"]) == 0
    assert {json.loads(x)["table"] for x in capsys.readouterr().out.splitlines()} == set(out)


def test_selection_and_geography(spark, tmp_path, caplog):
    texts = spark.createDataFrame([("a", "Шлак, шлаки и штейн. Россия, Норильск, Урал"), ("b", "nothing here"), ("c", None)], "doc_id string, text string")
    counts = {r.topic: r.n_documents for r in runs.selection_run(texts, {"slag": ["шлак", "штейн"], "gold": ["золот"]}, str(tmp_path / "targets"), "run1").collect()}
    assert counts == {"slag": 1, "gold": 0}
    (row,) = spark.read.json(str(tmp_path / "targets")).collect()
    assert (row.doc_id, row.matched_keywords, row.n_hits) == ("a", ["шлак", "штейн"], 3)
    assert any('"INGEST-003"' in r.message and "gold" in r.message and "run1" in r.message for r in caplog.records)
    docs = texts.select("doc_id", F.concat("doc_id", F.lit(".pdf")).alias("path"))
    counts = {r.geography: r.n for r in runs.geography_run(docs, texts, ["росси", "норильск", "урал"], ["canada", "chile", "usa"], str(tmp_path / "geo")).collect()}
    assert counts == {"ru": 1, "unknown": 2}
    rows = {r.doc_id: r for r in spark.read.json(str(tmp_path / "geo")).collect()}
    assert (rows["a"].method, rows["a"].snippet, rows["b"].method, rows["b"].snippet) == ("markers", None, "none", "nothing here")
    assert any('"INGEST-006"' in r.message for r in caplog.records)


def test_batches_go_on_where_they_stopped(spark, tmp_path):
    chunks = spark.createDataFrame([(f"c{i}", "d", "bad" if i == 3 else f"text {i}") for i in range(6)], "chunk_id string, doc_id string, text string")

    def service(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("refused")
        return [[1.0] for _ in texts]

    paths = str(tmp_path / "vectors"), str(tmp_path / "skipped")
    assert runs.embedding_run(chunks.filter("chunk_id < 'c4'"), *paths, service) == (3, 1)
    assert runs.embedding_run(chunks, *paths, service) == (2, 1)
    assert runs.embedding_run(chunks, *paths, lambda texts: [[2.0] for _ in texts]) == (1, 0)
    rows = {r.chunk_id: r.embedding for r in spark.read.parquet(paths[0]).collect()}
    assert rows == {f"c{i}": [2.0 if i == 3 else 1.0] for i in range(6)} and spark.read.parquet(paths[1]).count() == 0


def test_extraction_retries_checks_and_isolates(spark, tmp_path):
    mark = str(tmp_path / "tried")

    def ask(chunk):
        import os

        if chunk == "down":
            raise ConnectionError("no route")
        if chunk == "second" and not os.path.exists(mark):
            open(mark, "w").close()
            return "sorry"
        if chunk == "never":
            return '{"entities": "none", "relations": []}'
        if chunk == "blank":
            return '{"entities": [{"name": " "}], "relations": []}'
        return f'<think>so\n</think>```json\n{{"entities": [{{"name": "{chunk}", "type": "Material"}}], "relations": [{{"source": "a", "target": "b", "type": "USES_MATERIAL", "confidence": 0.5}}]}}\n```'

    chunks = spark.createDataFrame([(t, "d", t) for t in ("fine", "second", "never", "blank", "down")] + [("none", "d", None)], "chunk_id string, doc_id string, text string")
    got = {r.chunk_id: r for r in runs.extracted(chunks, ask, model="m").collect()}
    assert {k: r.error.code if r.error else None for k, r in got.items()} == {"fine": None, "second": None, "none": "EXTRACT-001", "never": "EXTRACT-001", "blank": "EXTRACT-001", "down": "EXTRACT-004"}
    assert got["second"].entities[0].name == "second" and got["fine"].relations[0].confidence == 0.5 and got["fine"].model == "m"


def test_catalog_vectors(spark):
    entries = spark.createDataFrame([("x", "bad title", "", 1), ("y", "fine", "a card", 2), ("z", "empty", "", 0)], "catalog_id string, title string, description string, n_files int")

    def service(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("refused")
        return [[1.0] for _ in texts]

    got = {r.catalog_id: r for r in runs.catalog_vectors(entries, service).collect()}
    assert got["x"].embedding is None and got["x"].error.code == "INGEST-005"
    assert list(got["y"].embedding) == [1.0] and got["y"].error is None and got["z"].error.code == "INGEST-004"


def test_command_line_routes(spark, capsys):
    assert cli.main(["route", "Какие способы закачки шахтных вод применялись за рубежом?"]) == 0
    said = json.loads(capsys.readouterr().out)
    assert said["template"] == "mine_water_injection" and said["geography"] == "foreign"
