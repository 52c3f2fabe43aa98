"""Masked pseudo-likelihood: a bidirectional window network predicts every word from both sides.

Words are folded into classes: the most frequent ones over all documents keep their own,
the rest share a few by hash. The network adds up a vector for each of the ``window`` classes
on either side (a table of vectors per distance), and a softmax over all classes scores the
class in the middle. It begins as the best such network of low rank for the counts of class
pairs at each distance, and as the counts of single classes in its bias. Training then
covers every position once: the words are written as segments of classes, each belongs to
one of ``rounds`` by a hash of its content, and a round's gradient is summed over all
positions of its segments on the executors and makes one step. Counts and gradients are sums
over the corpus, so the result doesn't depend on how it is partitioned.

A word's probability is that of its class given both sides, times its share of the class by
the counts of all words, so the vocabulary is every word there is. Of the counts the most
frequent ones are broadcast; the others reach the words of a document by a join. A
document's score is the sum over all its positions of log p(word | both sides).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestone import session
from lodestone.llm import rolling
from lodestone.llm.arrowtext import by_bytes, id_text
from lodestone.llm.staging import joined_bytes

U = np.uint64


def hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = joined_bytes([t.lower().encode() for t in texts])
    starts, ends, rows = rolling.word_spans(raw, offsets)
    return rolling.word_hashes(raw, starts, ends, 51), rows


def word_counts(rows: DataFrame) -> DataFrame:
    """(h, n): how often each word, by its hash, occurs in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in by_bytes(batches, 1 << 20):
            words, _ = hashes(part.column("text").to_pylist())
            held.append(words)
            size += len(words)
            if size >= 4_000_000:
                yield counted(held)
                held, size = [], 0
        if size:
            yield counted(held)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        values, times = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(times.astype(np.int64))], ["h", "n"])

    return rows.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def at_least(counts: DataFrame, most: int, least: int) -> tuple[int, int]:
    """Two bounds of counts: no more than ``most`` words reach the first, and ``least`` words or all reach the second.

    Words are counted by powers of two to the quarter, so the driver gets some hundred rows at any size;
    a plain limit would send it that many words of every partition.
    """
    found = counts.groupBy(F.floor(4 * F.log2("n")).alias("b")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("n"), F.max("n").alias("top")).orderBy(F.desc("b")).collect()
    bound, enough, seen = (found[0].top + 1 if found else 1), 1, 0
    for row in found:
        if seen < least:
            enough = row.n
        seen += row.words
        if seen <= most:
            bound = row.n
    return bound, enough if seen >= least else 1


class Classes:
    """Word hash to class: 0 is the edge of a text, then the frequent words, then the shared classes."""

    def __init__(self, frequent: np.ndarray, shared: int):
        self.words = np.sort(frequent.astype(U))
        self.shared = shared
        self.n = 1 + len(self.words) + shared

    def of(self, words: np.ndarray) -> np.ndarray:
        rest = 1 + len(self.words) + (words % U(self.shared)).astype(np.int64)
        if not len(self.words):
            return rest
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, 1 + at, rest)


class WindowNetwork:
    def __init__(self, classes: int, width: int, window: int, seed: int):
        rng = np.random.default_rng(seed)
        self.window = window
        self.near = (rng.standard_normal((2 * window, classes, width)) * 0.1).astype(np.float32)
        self.out = (rng.standard_normal((classes, width)) * 0.1).astype(np.float32)
        self.bias = np.zeros(classes, np.float32)

    @classmethod
    def of_counts(cls, sizes: np.ndarray, pairs: np.ndarray, width: int, smooth: float = 30.0, share: float = 0.5) -> WindowNetwork:
        """From how often each class stands alone, and before another at each distance (window x classes x classes).

        How much more often than by chance two classes meet, in logarithms, is factorised; the
        distances tell the same thing in part, so each gets a ``share``.
        """
        classes, window = len(sizes), len(pairs)
        net = cls(classes, min(width, classes), window, 0)
        chance = (sizes + 0.5) / (sizes + 0.5).sum()
        # Contexts in the order of ``context``: far to near on the left, near to far on the right.
        given = np.concatenate([*pairs[::-1], *pairs.transpose(0, 2, 1)]).astype(float)
        more = np.log((given + smooth * chance) / ((given.sum(axis=1, keepdims=True) + smooth) * chance))
        more[:, 0] = 0  # an edge is never a target
        weight = np.sqrt(given.sum(axis=1) + 1)[:, None]
        left, power, right = np.linalg.svd(more * weight, full_matrices=False)
        left, power, right = left[:, : net.out.shape[1]], np.sqrt(power[: net.out.shape[1]]), right[: net.out.shape[1]]
        scale = np.sqrt(weight.mean())
        net.near[...] = (share * left * power / weight * scale).reshape(net.near.shape)
        net.out[...] = (right.T * power) / scale
        net.bias[...] = np.log(chance)
        return net

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.near, self.out, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights])

    def load(self, flat: np.ndarray) -> WindowNetwork:
        at = 0
        for w in self.weights:
            w[...] = flat[at : at + w.size].reshape(w.shape)
            at += w.size
        return self

    def context(self, classes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Classes around positions; ``classes`` has ``window`` edges on both sides of every text."""
        k = self.window
        return np.stack([classes[at + d] for d in (*range(-k, 0), *range(1, k + 1))], axis=1)

    def powers(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each position: what its context adds up to, and a one; the exponentials of all classes' logits, and by how much these were lowered."""
        hidden = np.empty((len(around), self.out.shape[1] + 1), np.float32)
        hidden[:, -1] = 1
        np.take(self.near[0], around[:, 0], axis=0, out=hidden[:, :-1])
        for d in range(1, around.shape[1]):
            hidden[:, :-1] += self.near[d][around[:, d]]
        logits = hidden @ np.c_[self.out, self.bias].T
        lower = np.zeros(len(around), np.float32)
        if len(logits) and logits.max() > 60:
            lower = logits.max(axis=1)
            logits -= lower[:, None]
        return hidden, np.exp(logits, out=logits), lower

    def score(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        hidden, power, lower = self.powers(around)
        picked = np.einsum("ij,ij->i", hidden[:, :-1], self.out[target]) + self.bias[target]
        return picked - lower - np.log(power @ np.ones(power.shape[1], np.float32))

    def gradient(self, around: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        """Of the summed log-probability, by all weights. Probabilities aren't written out: their sums scale the smaller factors."""
        hidden, power, _ = self.powers(around)
        back = power @ np.c_[self.out, np.ones(len(self.out), np.float32)]
        share = hidden / back[:, -1:]
        out = -(power.T @ share)
        add_rows(out, target, hidden)
        back = self.out[target] - back[:, :-1] / back[:, -1:]
        near = np.zeros_like(self.near)
        for d in range(around.shape[1]):
            add_rows(near[d], around[:, d], back)
        return [near, out[:, :-1], out[:, -1]]


def add_rows(to: np.ndarray, place: np.ndarray, rows: np.ndarray) -> None:
    """Add each row at its place; places of 16 bits are sorted by radix."""
    place = place.astype(np.uint16)
    order = np.argsort(place, kind="stable")
    held = place[order]
    first = np.flatnonzero(np.r_[True, held[1:] != held[:-1]])
    to[held[first]] += np.add.reduceat(rows[order], first, axis=0)


def laid_out(classes: np.ndarray, rows: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes with ``window`` edges around every text, and where the words stand in them."""
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    at = np.arange(len(classes)) + (row + 1) * window
    out = np.zeros(len(classes) + len(rows) * window, np.int64)
    out[at] = classes
    return out, at


def segments(rows: DataFrame, classes: Classes, window: int, rounds: int, longest: int = 8192) -> DataFrame:
    """(turn, c): classes of up to ``longest`` positions in a row with ``window`` neighbours on both sides, and the round in which they train."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, 1 << 20):
            words, offsets = hashes(part.column("text").to_pylist())
            text, at = laid_out(classes.of(words), offsets, window)
            text, turns, out = text.astype("<u2"), [], []
            for a, b in zip(offsets, offsets[1:]):
                for k in range(int(a), int(b), longest):
                    first, last = at[k], at[min(k + longest, int(b)) - 1]
                    out.append(text[first - window : last + window + 1].tobytes())
                    turns.append(zlib.crc32(out[-1]) % rounds)
            yield pa.RecordBatch.from_arrays([pa.array(turns, pa.int32()), pa.array(out, pa.binary())], ["turn", "c"])

    return rows.mapInArrow(cut, "turn int, c binary")


def unpacked(batches: Iterator[pa.RecordBatch], window: int, limit: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Segments laid one behind the other, and where their targets stand."""
    for part in by_bytes(batches, limit, "c"):
        held = [np.frombuffer(c, "<u2") for c in part.column("c").to_pylist()]
        ends = np.cumsum([len(c) for c in held])
        inside = np.ones(ends[-1], bool)
        for e, c in zip(ends, held):
            inside[e - len(c) : e - len(c) + window] = inside[e - window : e] = False
        yield np.concatenate(held).astype(np.int64), np.flatnonzero(inside)


def pair_counts(table: DataFrame, classes: int, window: int) -> np.ndarray:
    """How often each class stands ``d`` places before another (window x classes x classes), edges included; sums over all segments."""
    square = classes * classes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(window * square, np.int64)
        for text, at in unpacked(batches, window):
            for d in range(1, window + 1):
                # A pair counts with its later word; where that is an edge, with its earlier one.
                edge = at[text[at + d] == 0]
                key = np.r_[text[at - d] * classes + text[at], text[edge] * classes]
                total[(d - 1) * square : d * square] += np.bincount(key, minlength=square)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(total[k], pa.int64())], ["k", "n"])

    found = table.select("c").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(window * square, np.int64)
    out[found["k"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out.reshape(window, classes, classes)


def summed(parts: DataFrame, size: int) -> tuple[int, np.ndarray]:
    """The sum of rows (n, w: doubles as bytes): first in groups of about the root of their number, then on the driver.

    The groups are collected at once: an iterator over them goes on after its plan counts as run,
    when ``session.tidy`` has deleted the shuffle files, and every row would be worked out again.
    """
    groups = math.isqrt(max(1, parts.rdd.getNumPartitions())) + 1

    def add(held: pa.Table) -> pa.Table:
        total = np.zeros(size)
        for w in held.column("w").to_pylist():
            total += np.frombuffer(w, "<f8")
        return pa.table({"n": pa.array([sum(held.column("n").to_pylist())]), "w": pa.array([total.astype("<f8").tobytes()], pa.binary())})

    n, total = 0, np.zeros(size)
    grouped = parts.groupBy((F.col("part") % groups).alias("g")).applyInArrow(add, "n long, w binary")
    for row in grouped.collect():
        n, total = n + row.n, total + np.frombuffer(row.w, "<f8")
    return n, total


def train(rows: DataFrame, classes: Classes, sizes: np.ndarray, *, width: int = 16, window: int = 2, rounds: int = 6, batch: int = 2048, rate: float = 0.05) -> WindowNetwork:
    """The network for a corpus; ``sizes``: how often each class occurs. Every position is a target once."""
    spark = rows.sparkSession
    path = session.scratch_path(spark, "segments")
    segments(rows, classes, window, rounds).write.partitionBy("turn").parquet(path)
    table = spark.read.schema("c binary, turn int").parquet(path)
    network = WindowNetwork.of_counts(sizes, pair_counts(table, classes.n, window), width)
    flat = network.flat().astype(float)
    first, second = np.zeros_like(flat), np.zeros_like(flat)
    for turn in range(rounds):
        start = spark.sparkContext.broadcast(network)

        def learn(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            net, total, seen = start.value, None, 0
            for text, at in unpacked(batches, window):
                for k in range(0, len(at), batch):
                    some = at[k : k + batch]
                    found = net.gradient(net.context(text, some), text[some])
                    total = found if total is None else [t + f for t, f in zip(total, (x.astype(float) for x in found))]
                seen += len(at)
            if seen:
                flat = np.concatenate([t.ravel() for t in total]).astype("<f8")
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([seen], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["part", "n", "w"])

        mine = table.filter(F.col("turn") == turn).select("c")
        n, total = summed(mine.mapInArrow(learn, "part int, n long, w binary"), len(flat))
        start.unpersist()
        if n:
            step = total / n
            first, second = 0.6 * first + 0.4 * step, 0.8 * second + 0.2 * step**2
            flat += rate * (first / (1 - 0.6 ** (turn + 1))) / (np.sqrt(second / (1 - 0.8 ** (turn + 1))) + 1e-4)
            network.load(flat)
    session.drop_path(spark, path)
    return network


def class_sizes(counts: DataFrame, classes: Classes) -> np.ndarray:
    """How often the words of each class occur, together."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes.n, np.int64)
        for part in batches:
            np.add.at(total, classes.of(part.column("h").to_numpy().view(U)), part.column("n").to_numpy())
        c = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(total[c], pa.int64())], ["c", "n"])

    found = counts.mapInArrow(add, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(classes.n, np.int64)
    out[found["c"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", frequent: int = 191, shared: int = 64, near_counts: int = 1 << 16, **training) -> DataFrame:
    """(doc_id, n_tokens, log_prob, mean_log_prob) of every row.

    Null, empty and blank texts have no tokens, log_prob 0 and a null mean. Repeated rows and
    null ids are scored like others; an empty table gives an empty result; other columns are
    ignored. ``near_counts`` changes how counts reach the documents, not the result. The driver
    gets that many words' counts, the counts of class pairs, and in each round about as many sums of gradients as the root of the number of partitions.
    """
    with session.tidy(docs.sparkSession):
        return _score(id_text(docs, id_col, text_col), frequent, shared, near_counts, **training)


def _score(rows: DataFrame, frequent: int, shared: int, near_counts: int, **training) -> DataFrame:
    counts = session.stored(word_counts(rows), "words")
    bound, enough = at_least(counts, near_counts, frequent)
    top = counts.filter(F.col("n") >= enough).orderBy(F.desc("n"), "h").limit(max(1, frequent)).toPandas()
    classes = Classes(top["h"].to_numpy(np.int64).view(U)[:frequent], shared)
    near = counts.filter(F.col("n") >= bound).toPandas()
    near_h, near_n = near["h"].to_numpy(np.int64).view(U), near["n"].to_numpy(np.int64)
    sizes = class_sizes(counts, classes)
    network = train(rows, classes, sizes, **training)
    by = np.argsort(near_h)
    log_size = np.log(np.maximum(sizes, 1))
    given = rows.sparkSession.sparkContext.broadcast((network, classes, log_size, near_h[by], np.log(near_n[by])))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        net, known, log_size, near, log_n = given.value
        row = TaskContext.get().partitionId() << 40
        for part in by_bytes(batches, 1 << 19):
            words, offsets = hashes(part.column("text").to_pylist())
            own = known.of(words)
            text, at = laid_out(own, offsets, net.window)
            found = np.zeros(len(at))
            for k in range(0, len(at), 2048):
                found[k : k + 2048] = net.score(net.context(text, at[k : k + 2048]), text[at[k : k + 2048]])
            found -= log_size[own]
            place = np.minimum(np.searchsorted(near, words), max(0, len(near) - 1))
            rare = near[place] != words if len(near) else np.ones(len(words), bool)
            found[~rare] += log_n[place[~rare]]
            total = np.diff(np.r_[0.0, np.cumsum(found)][offsets])
            n = np.diff(offsets)
            ends = np.r_[0, np.cumsum(rare)][offsets].astype(np.int32)
            far = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words[rare].view(np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(len(n)), pa.int64()), part.column("doc_id"), pa.array(n, pa.int64()), pa.array(total), far], ["row", "doc_id", "n_tokens", "log_prob", "far"])
            row += len(n)

    scored = session.stored(rows.mapInArrow(each, "row long, doc_id long, n_tokens long, log_prob double, far array<long>"), "scored")
    far = scored.select("row", F.explode("far").alias("h")).join(counts.hint("merge"), "h")
    more = far.groupBy("row").agg(F.sum(F.log("n")).alias("more"))
    total = F.col("log_prob") + F.coalesce("more", F.lit(0.0))
    whole = scored.select("row", "doc_id", "n_tokens", "log_prob").join(more.hint("merge"), "row", "left").withColumn("log_prob", total)
    return whole.select("doc_id", "n_tokens", "log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob"))
