"""Incremental upserts from a stream of entity rows: each micro-batch is merged into the table once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.operators import upsert


def merge_stream(spark: SparkSession, source: str, schema: str, table: str, checkpoint: str) -> None:
    """Read what is new under ``source`` (Parquet), merge it into ``table`` by the entities' monotone rules, and stop.

    A batch that is run again after a failure changes nothing: the rules only ever raise values.
    """

    def merge(batch: DataFrame, _: int) -> None:
        rows = batch.groupBy("id").agg(F.min_by("name", "name").alias("name"), F.max("n_mentions").alias("n_mentions"), F.max("confidence").alias("confidence"), F.max("is_tech_solution").alias("is_tech_solution"))
        try:
            old = spark.read.parquet(table)
        except Exception as error:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(error):
                raise
            old = rows.limit(0)
        upsert.swap_in(upsert.upsert_entities(old, rows.select(*old.columns)), table)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
