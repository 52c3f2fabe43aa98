"""Documents laid out once by id, compressed, so that later joins on the id move no text."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone import session
from lodestone.llm.arrowtext import by_bytes, id_text

PACKED = pa.schema([("doc_id", pa.int64()), ("packed", pa.binary())])


def discard(*tables: DataFrame) -> None:
    """Delete tables written by ``bucketed`` that nothing reads any more."""
    for table in tables:
        name, path = table.written
        table.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        session.drop_path(table.sparkSession, path)


def partitions(df: DataFrame) -> int:
    """As many partitions as the scan of ``df`` has, so they keep their size as the input grows, and no fewer than Spark's shuffles have.

    With fewer, rows dealt out by a shuffle would go to several buckets in every task, a file each.
    """
    spark = df.sparkSession
    return max(1, df.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    for part in by_bytes(batches, 4 << 20):
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([press.compress(t.as_buffer()) for t in part.column("text")], pa.binary())], schema=PACKED)


def bucketed(df: DataFrame, label: str, n: int, key: str, order: list[str], dealt: bool = False, path: str | None = None) -> DataFrame:
    """Write ``df`` to ``path``, or the shared folder, in ``n`` buckets by the hash of ``key``; joins on it need no exchange.

    ``dealt``: the rows lie in such buckets already.
    """
    spark = df.sparkSession
    name, path = f"lodestone_{label}_{uuid.uuid4().hex}", path or session.scratch_path(spark, label)
    rows = df if dealt else df.repartition(n, key)
    with session.tidy(spark):
        rows.sortWithinPartitions(*order).write.format("parquet").bucketBy(n, key).sortBy(*order).option("path", path).saveAsTable(name)
    table = spark.table(name)
    table.written = (name, path)
    return table


def attached(spark: SparkSession, path: str, schema: str, n: int, key: str) -> DataFrame:
    """A table that ``bucketed`` wrote to ``path`` in another session."""
    name = f"lodestone_attached_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({key}) INTO {n} BUCKETS LOCATION '{path}'")
    table = spark.table(name)
    table.written = (name, path)
    return table


def stage(docs: DataFrame, id_col: str, text_col: str, n: int | None = None, path: str | None = None) -> tuple[DataFrame, int]:
    """(doc_id, packed) by id, and the number of its buckets."""
    rows = id_text(docs, id_col, text_col)
    n = n or partitions(rows)
    return bucketed(rows.mapInArrow(pack, "doc_id long, packed binary"), "docs", n, "doc_id", ["doc_id"], path=path), n


def unpacked(batches: Iterator[pa.RecordBatch], limit: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of record batches of about ``limit`` bytes of text, with their texts."""
    import zstandard

    press = zstandard.ZstdDecompressor()
    for batch in batches:
        packed = batch.column("packed").to_pylist()
        sizes, at, held = [zstandard.frame_content_size(x) for x in packed], 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(at, i - at), [press.decompress(x) for x in packed[at:i]]
                at, held = i, 0
            held += size
        if at < batch.num_rows:
            yield batch.slice(at), [press.decompress(x) for x in packed[at:]]


def joined_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, and the n + 1 offsets of the texts in it."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offsets


#: A row's own number in tables whose ids repeat.
ROW = "__row"


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs``, written to the shared folder, with unique numbers that ascend with the id (none: last) and, within one, with the MD5 of the text."""
    order = [F.col(id_col).cast("long").asc_nulls_last(), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))]
    dealt = docs.repartitionByRange(partitions(docs), *order).sortWithinPartitions(*order)
    return session.stored(dealt.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def repeats(docs: DataFrame, id_col: str) -> bool:
    """Whether an id, or its lack, stands in several rows."""
    with session.tidy(docs.sparkSession):
        return not docs.groupBy(F.col(id_col).cast("long")).count().filter("count > 1").isEmpty()


def with_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with the unique column ``ROW``: the id, where every row has one of its own."""
    plain = not repeats(docs, id_col) and docs.filter(F.col(id_col).isNull()).isEmpty()
    return docs.withColumn(ROW, F.col(id_col).cast("long")) if plain else numbered(docs, id_col, text_col)


def with_unique_ids(docs: DataFrame, id_col: str, text_col: str, operator: Callable[[DataFrame, str], DataFrame], ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """What ``operator`` (rows, id column) makes of the rows with an id.

    Where ids repeat, each row is a document of its own under a number in its place, and the
    numbers in the columns ``ids`` of the result are turned back into ids. Shuffle files of
    whatever the operator runs on its way go at once.
    """
    given = docs.filter(F.col(id_col).isNotNull())
    again = repeats(given, id_col)
    with session.tidy(docs.sparkSession):
        rows = numbered(given, id_col, text_col) if again else given
        out = operator(rows, ROW if again else id_col)
    if not again:
        return out
    columns = out.columns
    for c in ids:
        names = rows.select(F.col(ROW).alias(c), F.col(id_col).cast("long").alias("__id"))
        out = out.join(names, c).withColumn(c, F.col("__id")).drop("__id")
    return out.select(*columns)


class Seen:
    """Which keys of 128 bits a task has met before, in documents with smaller ids.

    A table of fixed size in which a later key replaces an earlier one in its slot, so a
    frequent key stays and a lost one costs a row more but never a wrong answer.
    """

    def __init__(self, bits: int = 18):
        self.shift = np.uint64(64 - bits)
        self.a, self.b = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        self.doc, self.count = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int8)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a ^ (b << 1)).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def times(self, a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """How often (2: twice or more) each key stood in a document with a smaller id."""
        at = self.slots(a, b)
        return np.where((self.a[at] == a) & (self.b[at] == b) & (self.doc[at] < doc), self.count[at], 0)

    def add(self, a: np.ndarray, b: np.ndarray, doc: np.ndarray, count: np.ndarray | int = 1) -> None:
        """Keys that ``times`` knows by now get ``count`` more; the others take their slots."""
        at = self.slots(a, b)
        more = np.where((self.a[at] == a) & (self.b[at] == b), self.count[at], 0) + count
        self.a[at], self.b[at], self.doc[at], self.count[at] = a, b, doc, np.minimum(more, 2)


def with_lists(staged: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """``staged`` joined with the list ``items`` of each document's rows (all columns but doc_id)."""
    columns = [c for c in rows.columns if c != "doc_id"]
    lists = rows.groupBy("doc_id").agg(*(F.collect_list(c).alias(c) for c in columns))
    return staged.join(lists.hint("shuffle_merge"), "doc_id", how)


def flat(part: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column in a row, and the row that each belongs to; a null list is empty."""
    column = part.column(name)
    values = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    return values, np.repeat(np.arange(part.num_rows), sizes)


def ceil_log2(x: float) -> int:
    return max(0, math.ceil(math.log2(max(1.0, x))))
