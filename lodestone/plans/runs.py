"""Whole runs over a corpus: conversion, selection by topic, geography, batches that can be resumed, extraction records, catalog vectors.

Every run reads tables and writes tables; what fails for one row becomes a row of a side output
with a code and a reason. Texts are put together, matched and classified on the executors.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lodestone import session
from lodestone.functions import chunking, text
from lodestone.operators import providers, upsert
from lodestone.sources import corpus

log = logging.getLogger("lodestone")
#: Characters of a text that are kept for documents whose geography isn't known.
SNIPPET = 1200
EXTRACTED = "entities array<struct<name:string,type:string,synonyms:array<string>,attrs:map<string,string>>>, relations array<struct<source:string,target:string,type:string,confidence:double>>"


def report(code: str, detail: str, run_id: str = "", level: int = logging.WARNING) -> None:
    log.log(level, json.dumps({"event": code, "detail": detail[:500], "run_id": run_id}, ensure_ascii=False))


def write_json(df: DataFrame, path: str) -> None:
    """Overwrite a table of JSON lines; null fields are kept, so that the schema can be read back from any row."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def corpus_run(spark: SparkSession, folder: str, core: tuple[str, ...], out: str, *, this_year: int, backends: Mapping[str, corpus.Backend] | None = None) -> dict[str, DataFrame]:
    """Files to ``documents``, ``texts``, ``chunks`` and ``skipped`` under ``out``, all overwritten; the files are converted once."""
    read = session.stored(corpus.documents(corpus.files(spark, folder, core), this_year, backends=dict(backends or {})), "converted")
    good, skipped = upsert.split_failed(read)
    texts = good.select("doc_id", "text", F.length("text").alias("n_chars"))
    written = {"documents": good.drop("text"), "texts": texts, "chunks": chunking.chunk_table(texts), "skipped": skipped}
    for name, rows in written.items():
        write_json(rows, f"{out}/{name}")
    return {name: spark.read.schema(rows.schema).json(f"{out}/{name}") for name, rows in written.items()}


def whole_texts(chunks: DataFrame) -> DataFrame:
    """(doc_id, text): a document's chunks in order, one under the other."""
    ordered = F.array_sort(F.collect_list(F.struct("start", "chunk_id", "text")))
    return chunks.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


def targets(texts: DataFrame, topics: Mapping[str, Sequence[str]]) -> DataFrame:
    """(doc_id, topic, matched_keywords, n_hits) of every topic that a text has keywords of; the count is of all occurrences."""
    found = [
        F.struct(F.lit(t).alias("topic"), F.filter(F.array(*(F.when(text.topic_hits(F.col("text"), [k]) > 0, k) for k in keywords)), lambda k: k.isNotNull()).alias("matched_keywords"), text.topic_hits(F.col("text"), keywords).cast("int").alias("n_hits"))
        for t, keywords in topics.items()
    ]
    return texts.select("doc_id", F.explode(F.array(*found)).alias("t")).select("doc_id", "t.*").filter("n_hits > 0")


def selection_run(texts: DataFrame, topics: Mapping[str, Sequence[str]], path: str, run_id: str = "") -> DataFrame:
    """Writes the targets; (topic, n_documents) of every topic, with INGEST-003 in the log for those without any."""
    write_json(targets(texts, topics), path)
    spark = texts.sparkSession
    kept = spark.read.schema(T._parse_datatype_string(corpus.SCHEMAS["targets"])).json(path)
    every = spark.createDataFrame([(t,) for t in topics], "topic string")
    counts = every.join(kept.groupBy("topic").agg(F.count_distinct("doc_id").alias("n")), "topic", "left").select("topic", F.coalesce("n", F.lit(0)).alias("n_documents"))
    for row in counts.filter("n_documents = 0").orderBy("topic").collect():  # a row a topic at most
        report("INGEST-003", f"no document for {row.topic}", run_id)
    return counts


def geographies(documents: DataFrame, texts: DataFrame, ru: Sequence[str], foreign: Sequence[str]) -> DataFrame:
    """(doc_id, path, geography, method, ru_hits, foreign_hits, evidence, snippet) of every document; those without a text are unknown.

    ``method`` tells markers from ``none``; the text's start is kept where they don't decide.
    """
    rows = documents.select("doc_id", "path").join(texts.select("doc_id", "text"), "doc_id", "left")
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = rows.withColumn("g", text.geography(F.lower(body), ru, foreign))
    unknown = F.col("g.geography") == "unknown"
    return rows.select("doc_id", "path", "g.geography", F.when(unknown, "none").otherwise("markers").alias("method"), "g.ru_hits", "g.foreign_hits", "g.evidence", F.when(unknown, F.substring(body, 1, SNIPPET)).alias("snippet"))


def geography_run(documents: DataFrame, texts: DataFrame, ru: Sequence[str], foreign: Sequence[str], path: str, run_id: str = "") -> DataFrame:
    """Writes the geographies; (geography, n). INGEST-006 in the log says how many are unknown."""
    found = geographies(documents, texts, ru, foreign)
    write_json(found, path)
    counts = found.sparkSession.read.schema(found.schema).json(path).groupBy("geography").agg(F.count(F.lit(1)).alias("n"))
    for row in counts.filter("geography = 'unknown'").collect():
        report("INGEST-006", f"{row.n} documents of unknown geography", run_id)
    return counts


def resumable(rows: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, skipped_path: str, key: str = "chunk_id", target_rows: DataFrame | None = None) -> tuple[int, int]:
    """Work on rows that an earlier run hasn't done, appended to ``path``; rows with an ``error`` go to ``skipped_path`` and are tried again next time.

    Returns how many were added and skipped. The work is done once: it is stored before it is divided.
    """
    spark = rows.sparkSession
    done = spark.read.parquet(path).select(key) if session.exists(spark, path) else rows.select(key).limit(0)
    worked = session.stored(work(upsert.pending(rows, done, key, target_rows)), "batch")
    good, bad = upsert.split_failed(worked)
    good.write.mode("append").parquet(path)
    bad.write.mode("overwrite").parquet(skipped_path)
    counted = worked.agg(F.count_if(F.col("error").isNull()).alias("good"), F.count_if(F.col("error").isNotNull()).alias("bad")).first()
    return counted.good, counted.bad


def embedding_run(chunks: DataFrame, path: str, skipped_path: str, embed: providers.Embed = providers.hashed_words) -> tuple[int, int]:
    return resumable(chunks, lambda rows: providers.embedded(rows, embed), path, skipped_path)


def _record(raw: Column) -> Column:
    """A model's answer as a record: thoughts and fences removed; null where it isn't an object with lists of entities and relations."""
    said = text.strip_fences(text.strip_think(raw))
    record = F.from_json(said, EXTRACTED, {"mode": "PERMISSIVE"})
    plain = F.from_json(said, "entities string, relations string")
    lists = F.trim(plain["entities"]).startswith("[") & F.trim(F.coalesce(plain["relations"], F.lit("[]"))).startswith("[")
    sound = F.forall(record["entities"], lambda e: F.length(F.trim(e["name"])) > 0)
    return F.when(lists & record["entities"].isNotNull() & sound, record)


def extracted(chunks: DataFrame, ask: Callable[[str], str], *, attempts: int = 2, model: str = "") -> DataFrame:
    """(chunk_id, doc_id, entities, relations, model, error) of (chunk_id, doc_id, text) by a language model's answers.

    ``ask`` is called on the executors with a chunk's text. An answer that isn't the record asked
    for is asked for again; after ``attempts`` the row gets EXTRACT-001. Where no call succeeds
    the row gets EXTRACT-004. One row's failure leaves the others.
    """
    session.prepare(chunks.sparkSession)
    current = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    schema = "chunk_id string, doc_id string, text string, raw string, reason string"

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            said: list[tuple[str | None, str | None]] = []
            for chunk in frame["text"].fillna(""):
                try:
                    said.append((ask(chunk), None))
                except Exception as error:  # a service may fail in any way
                    said.append((None, f"{type(error).__name__}: {error}"[:300]))
            yield frame.assign(raw=[s for s, _ in said], reason=[r for _, r in said])

    out, left = None, current
    for attempt in range(attempts):
        # Stored, so that no answer is paid for twice.
        answers = session.stored(left.mapInPandas(call, schema).withColumn("record", _record(F.col("raw"))), "answers")
        good = answers.filter("record is not null").drop("raw", "reason")
        out = good if out is None else out.unionByName(good)
        bad = answers.filter("record is null")
        left = bad.select("chunk_id", "doc_id", "text")
        if attempt < attempts - 1 and left.isEmpty():
            break
    code = F.when(F.col("raw").isNull(), F.struct(F.lit("EXTRACT-004").alias("code"), F.coalesce("reason", F.lit("no answer")).alias("reason"))).otherwise(F.struct(F.lit("EXTRACT-001").alias("code"), F.lit("not a record of entities and relations").alias("reason")))
    rows = out.select("chunk_id", "doc_id", "record.*", F.lit(None).cast("struct<code:string,reason:string>").alias("error"))
    failed = bad.select("chunk_id", "doc_id", "record.*", code.alias("error"))
    return rows.unionByName(failed).withColumn("model", F.lit(model))


def catalog_vectors(entries: DataFrame, embed: providers.Embed = providers.hashed_words) -> DataFrame:
    """Catalog cards with ``embedding``: of title and description, two tries, null on failure (``error``: INGEST-005), and INGEST-004 for empty cards."""
    said = F.trim(F.concat_ws(" ", "title", "description"))
    found = providers.embedded(entries.withColumn("text", said), embed).drop("text")
    failed = F.when(F.col("error").isNotNull(), F.struct(F.lit("INGEST-005").alias("code"), F.col("error.reason").alias("reason")))
    return found.withColumn("error", F.when(F.coalesce("n_files", F.lit(0)) <= 0, F.struct(F.lit("INGEST-004").alias("code"), F.lit("no files").alias("reason"))).otherwise(failed))
