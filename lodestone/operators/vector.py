"""Exact vector search and hybrid ranking as expressions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestone import session


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; -1 where one is null, empty or zero, or where sizes differ."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm(a) > 0) & (norm(b) > 0)
    return F.coalesce(F.when(usable, dot / (norm(a) * norm(b))), F.lit(-1.0))


def literal(vector: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def vector_search(chunks: DataFrame, vector: Sequence[float], top_k: int, documents: DataFrame | None = None, id_col: str = "chunk_id") -> DataFrame:
    """The ``top_k`` chunks nearest to a vector, best first (ties by id), with title and year where documents are given."""
    found = chunks.filter(F.col("embedding").isNotNull()).withColumn("score", cosine(F.col("embedding"), literal(vector)))
    found = found.orderBy(F.desc("score"), id_col).limit(top_k)
    return found if documents is None else found.join(documents.select("doc_id", "title", "year"), "doc_id", "left")


def search_many(chunks: DataFrame, questions: DataFrame, top_k: int, *, id_col: str = "chunk_id", question_col: str = "question_id", block: int = 512) -> DataFrame:
    """(question_id, chunk_id, score): the ``top_k`` nearest chunks of every question (question_id, vector); ties by chunk id.

    Exact: every question meets every chunk, in pairs of blocks (at most ``block`` questions, ``CHUNKS_AT_ONCE`` chunks)
    that executors make and exchange; nothing goes through the driver. A product of matrices finds
    the candidates of a pair of blocks, whose scores are then summed one dimension after the other, so equal vectors
    have equal scores wherever they stand. A task keeps only the best ``top_k`` of a question block's rows so far.
    Chunks without a usable vector aren't found; questions of another dimension, or zero, find nothing.
    """
    spark = session.prepare(chunks.sparkSession)
    usable = lambda c: F.col(c).isNotNull() & (F.size(c) > 0)
    kind = dict(chunks.dtypes)[id_col]
    asked = questions.filter(usable("vector")).select(F.col(question_col).cast("string").alias("id"), F.col("vector").alias("v"))
    known = chunks.filter(usable("embedding")).select(F.col(id_col).alias("id"), F.col("embedding").alias("v"))
    left = _packed(asked, "string", block).select(F.col("size"), F.col("ids").alias("q_ids"), F.col("packed").alias("q"))
    right = _packed(known, kind, CHUNKS_AT_ONCE).select(F.col("size").alias("c_size"), F.col("ids").alias("c_ids"), F.col("packed").alias("c"))
    pairs = left.repartition(spark.sparkContext.defaultParallelism).hint("shuffle_replicate_nl").crossJoin(right).filter("size = c_size")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, best = None, None  # of the question block at hand: rows of (question, chunk id, score)
        for batch in batches:
            for k in range(batch.num_rows):
                at = lambda c, k=k: batch.column(c)[k]
                size, ids = at("size").as_py(), at("q_ids").values
                if names is None or not ids.equals(names):
                    if best is not None:
                        yield _rows(names, best)
                    names, best = ids, None
                matrix = lambda c: np.frombuffer(at(c).as_py(), np.float64).reshape(-1, size)
                found = _best(matrix("q"), matrix("c"), at("c_ids").values, top_k)
                best = found if best is None else _kept(pa.concat_tables([best, found]), top_k)
        if best is not None:
            yield _rows(names, best)

    rows = pairs.mapInArrow(search, f"q string, id {kind}, score double")
    place = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))
    return rows.withColumn("n", place).filter(F.col("n") <= top_k).select(F.col("q").alias(question_col), F.col("id").alias(id_col), "score")


#: Chunks that meet a block of questions at a time: scores of a pair of blocks take 8 bytes each.
CHUNKS_AT_ONCE = 4096


def _packed(rows: DataFrame, kind: str, most: int) -> DataFrame:
    """(size, ids, packed): rows (id, v) in blocks of one dimension, vectors as bytes of a matrix; zero and incomplete ones are left out."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}

        def flushed(size: int, everything: bool) -> Iterator[pa.RecordBatch]:
            ids, data = pa.concat_arrays([i for i, _ in waiting[size]]), np.concatenate([d for _, d in waiting[size]])
            whole = len(ids) if everything else len(ids) - len(ids) % most
            for a in range(0, whole, most):
                part = ids[a : min(a + most, whole)]
                lists = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part)
                yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), lists, pa.array([data[a : a + len(part)].tobytes()], pa.binary())], ["size", "ids", "packed"])
            waiting[size] = [(ids[whole:], data[whole:])]

        for batch in batches:
            ids, lists = batch.column("id"), batch.column("v")
            sizes = np.diff(lists.offsets.to_numpy())
            for size in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == size)
                data = lists.take(pa.array(mine)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size)
                fine = np.isfinite(data).all(1) & data.any(1)
                waiting.setdefault(size, []).append((ids.take(pa.array(mine[fine])), np.ascontiguousarray(data[fine])))
                if sum(len(i) for i, _ in waiting[size]) >= most:
                    yield from flushed(size, False)
        for size in waiting:
            yield from flushed(size, True)

    return rows.mapInArrow(pack, f"size int, ids array<{kind}>, packed binary")


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, one dimension after the other, so that a row's does not depend on its place."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def _best(q: np.ndarray, c: np.ndarray, ids: pa.Array, top_k: int) -> pa.Table:
    """The best ``top_k`` rows of each question (its number in the block, chunk id, score) in a pair of blocks."""
    q_norm, c_norm = np.sqrt(_dots(q, q)), np.sqrt(_dots(c, c))
    score = (q / q_norm[:, None]) @ (c / c_norm[:, None]).T
    k = min(top_k, len(c))
    least = np.partition(score, len(c) - k, axis=1)[:, len(c) - k] if k else np.full(len(q), np.inf)
    parts = []
    for a in range(0, len(q), 64):  # many equal chunks are candidates of all questions at once
        mine, place = np.nonzero(score[a : a + 64] >= (least[a : a + 64] - 1e-9)[:, None])
        mine += a
        exact = np.concatenate([_dots(q[mine[i : i + 65536]], c[place[i : i + 65536]]) for i in range(0, max(1, len(mine)), 65536)])
        parts.append(_kept(pa.table({"q": mine, "id": ids.take(pa.array(place)), "score": exact / (q_norm[mine] * c_norm[place])}), top_k))
    return pa.concat_tables(parts)


def _kept(rows: pa.Table, top_k: int) -> pa.Table:
    """The first ``top_k`` rows of each question, best first, ties by id."""
    rows = rows.sort_by([("q", "ascending"), ("score", "descending"), ("id", "ascending")])
    q = rows.column("q").to_numpy()
    first = np.concatenate([[0], np.flatnonzero(np.diff(q)) + 1]) if len(q) else np.empty(0, int)
    return rows.filter(pa.array(np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < top_k))


def _rows(names: pa.Array, best: pa.Table) -> pa.RecordBatch:
    rows = best.combine_chunks()
    out = pa.table({"q": names.take(rows.column("q").combine_chunks()), "id": rows.column("id"), "score": rows.column("score")}).combine_chunks()
    return pa.RecordBatch.from_arrays([out.column(i).combine_chunks() for i in range(3)], ["q", "id", "score"])


def one_dimension(chunks: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose vector has the table's dimension, and the others with the reason."""
    fits = F.col("embedding").isNull() | (F.size("embedding") == dim)
    bad = chunks.filter(~fits).select("chunk_id", F.lit("GRAPH-002").alias("code"), F.concat(F.lit("dimension "), F.size("embedding").cast("string")).alias("reason"))
    return chunks.filter(fits), bad


def rank_graph_chunks(candidates: DataFrame, vector_hits: DataFrame, chunks: DataFrame, vector: Sequence[float]) -> DataFrame:
    """(chunk_id, ord, score): candidates by vector score where the search found them, else by cosine; stable in ``ord``."""
    known = vector_hits.select("chunk_id", F.col("score").alias("hit"))
    rows = candidates.join(known, "chunk_id", "left").join(chunks.select("chunk_id", "embedding"), "chunk_id", "left")
    return rows.select("chunk_id", "ord", F.coalesce("hit", cosine(F.col("embedding"), literal(vector))).alias("score"))


def merge_with_quota(graph: DataFrame, vector: DataFrame, graph_quota: int = 7, max_total: int = 12) -> DataFrame:
    """(chunk_id, position): the first ``graph_quota`` of the graph, then the vector side, then the graph's rest, up to ``max_total``.

    Both sides have (chunk_id, rank) from 1 on without repeats.
    """
    first = graph.filter(F.col("rank") <= graph_quota).select("chunk_id", F.lit(0).alias("phase"), "rank")
    rest = graph.filter(F.col("rank") > graph_quota).select("chunk_id", F.lit(2).alias("phase"), "rank")
    both = first.unionByName(vector.select("chunk_id", F.lit(1).alias("phase"), "rank")).unionByName(rest)
    best = both.groupBy("chunk_id").agg(F.min(F.struct("phase", "rank")).alias("best"))
    picked = best.orderBy("best.phase", "best.rank").limit(max_total)
    return picked.select("chunk_id", F.row_number().over(W.orderBy("best.phase", "best.rank")).alias("position"))


def best_per_document(hits: DataFrame, cited: DataFrame, top_k: int) -> DataFrame:
    """The best chunk of each document that isn't cited, best first."""
    rows = hits.filter("doc_id is not null and doc_id != ''").join(cited.select("doc_id").distinct(), "doc_id", "left_anti")
    first = W.partitionBy("doc_id").orderBy(F.desc("score"), "chunk_id")
    return rows.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n").orderBy(F.desc("score"), "chunk_id").limit(top_k)
