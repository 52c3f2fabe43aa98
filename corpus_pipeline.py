"""The corpus pipeline: five stages, each on what the one before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame. ``run`` applies them to ``documents``, writing each stage's rows to the shared
folder and reading them again, so a lost executor costs one stage's work at most.

Rows are judged one by one in every stage: rows that repeat an id are documents of their own
in the order of their texts' MD5, and rows without an id come after all others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone import session
from lodestone.llm import decontaminate, jaccard, lsm_dedup, piece_codec, quality
from lodestone.llm.staging import ROW, with_rows

#: Word shingles of near duplicates, and the percentage of them that two documents share.
SHINGLE, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that the isolation forest rejects go."""
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the one with the least id stays."""
    rows = with_rows(docs, "doc_id", "text")
    classes = jaccard.join(rows, id_col=ROW, k=SHINGLE, percent=PERCENT)
    first = classes.filter("doc_id = component_id").select(F.col("doc_id").alias(ROW))
    return rows.join(first, ROW, "left_semi").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under windows that start earlier go; texts that lose none stay as they are, and texts that lose all go."""
    rows = with_rows(docs, "doc_id", "text")
    found = lsm_dedup.repeated(rows, id_col=ROW).filter("n_removed > 0").select(F.col("doc_id").alias(ROW), "kept")
    text = F.coalesce("kept", "text")
    cut = rows.join(found, ROW, "left").withColumn("text", text)
    return cut.filter("kept is null or kept != ''").withColumn("n_chars", F.when(F.col("kept").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    rows = with_rows(docs, "doc_id", "text")
    hits = decontaminate.leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=ROW).select(F.col("doc_id").alias(ROW)).distinct()
    return rows.join(hits, ROW, "left_anti").select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of what is left, as digests."""
    return piece_codec.coded(docs, public_tokenizers.path("piece_bpe_32k.model"), digests=True)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", encoding),
]

#: The forest, the tables of the bit sampling and the encoder have no SQL form: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        done = session.stored(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            session.drop_path(spark, docs.path)
        docs = done
    return docs
