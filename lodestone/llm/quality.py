"""Quality rules with an isolation forest over the rules' statistics.

A forest of random splits is grown on clean labelled rows; a document that few splits set
apart from them is anomalous. The verdict's threshold is calibrated on labelled rows that
the forest hasn't seen. Both come from a bounded sample of labelled rows (``fit_rows``,
by hash of the id); the statistics and verdicts cover every document and whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestone import session
from lodestone.llm import rolling
from lodestone.llm.arrowtext import by_bytes, id_text

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_upper", "n_marks", "n_digits", "n_lines")


def _class(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_SYMBOLS, _UPPER, _MARKS, _DIGITS = (_class(x) for x in (SYMBOLS, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!?", b"0123456789"))


def dup_lines(text: str) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines), len(lines) - len(set(lines))


def repeat_words(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of every word: whether a 3-word window over it is found twice or more in its text."""
    covered = np.zeros(len(hashes), bool)
    grams = rolling.window_hash(rolling.prefix_sums(hashes, 21), 21, 3)
    at = np.flatnonzero(rolling.inside_rows(rows, len(grams), 3))
    if len(at):
        row = np.searchsorted(rows, at, side="right").astype(np.uint64)
        _, back, times = np.unique(rolling.mix(grams[at] + rolling.mix(row)), return_inverse=True, return_counts=True)
        again = at[times[back] > 1]
        for k in range(3):
            covered[again + k] = True
    return covered


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    raw, offsets = rolling.column_bytes(column)
    starts, ends, rows = rolling.word_spans(raw, offsets)
    per_row = lambda mask, at: np.diff(np.r_[0, np.cumsum(mask)][at])
    lead = (raw & 0xC0) != 0x80
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    lines = np.array([dup_lines(t) for t in column.to_pylist()], np.int64).reshape(-1, 2)
    return {
        "n_words": np.diff(rows),
        "word_chars": per_row(lead & ~blank, offsets),
        "n_symbols": per_row(_SYMBOLS[raw], offsets),
        "n_dup_lines": lines[:, 1],
        "n_repeat_words": per_row(repeat_words(rolling.word_hashes(raw, starts, ends, 1), rows), rows),
        "n_chars": per_row(lead, offsets),
        "n_upper": per_row(_UPPER[raw], offsets),
        "n_marks": per_row(_MARKS[raw], offsets),
        "n_digits": per_row(_DIGITS[raw], offsets),
        "n_lines": lines[:, 0],
    }


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    words, chars, lines = (np.maximum(1, s[k]).astype(float) for k in ("n_words", "n_chars", "n_lines"))
    return np.stack([
        np.minimum(s["word_chars"] / words, 30) / 30,
        np.minimum(s["n_symbols"] / words, 1),
        s["n_upper"] / chars,
        np.minimum(s["n_marks"] / words, 1),
        s["n_digits"] / chars,
        # A line or phrase that returns once is no fault in a short text.
        s["n_dup_lines"] / (lines + 8),
        s["n_repeat_words"] / (words + 50),
    ], axis=1)


def base_failed(s: dict[str, np.ndarray], min_words: int, max_repeat: int) -> np.ndarray:
    return (s["n_words"] < min_words) | (100 * s["n_repeat_words"] > max_repeat * s["n_words"])


def usual_path(n: np.ndarray | int) -> np.ndarray:
    """Mean path length of a search that fails among n points."""
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 2, 2 * (np.log(np.maximum(n, 2) - 1) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class IsolationForest:
    """Arrays by (tree, node) of a full binary tree: split feature (-1: leaf), split value, path length at the leaf."""

    feature: np.ndarray
    value: np.ndarray
    length: np.ndarray
    depth: int
    points: int
    threshold: float = math.inf

    @classmethod
    def grow(cls, rows: np.ndarray, trees: int, points: int, margin: float, seed: int) -> IsolationForest:
        rng = np.random.default_rng(seed)
        points = min(points, len(rows))
        depth = max(1, math.ceil(math.log2(max(2, points))))
        shape = (trees, 2 ** (depth + 1) - 1)
        forest = cls(np.full(shape, -1), np.zeros(shape), np.zeros(shape), depth, points)
        for t in range(trees):
            todo = [(0, 0, rows[rng.choice(len(rows), points, replace=False)])]
            while todo:
                node, level, here = todo.pop()
                if level == depth or len(here) <= 1:
                    forest.length[t, node] = level + usual_path(len(here))
                    continue
                k = int(rng.integers(rows.shape[1]))
                # The range is wider than the points', so that values no clean row has are cut off early.
                low, high = here[:, k].min() - margin, here[:, k].max() + margin
                cut = rng.uniform(low, high)
                forest.feature[t, node], forest.value[t, node] = k, cut
                todo += [(2 * node + 1, level + 1, here[here[:, k] < cut]), (2 * node + 2, level + 1, here[here[:, k] >= cut])]
        return forest

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / usual path): near 1 for points that few splits isolate."""
        total, each = np.zeros(len(rows)), np.arange(len(rows))
        for feature, value, length in zip(self.feature, self.value, self.length):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                k = feature[node]
                node = np.where(k < 0, node, 2 * node + 1 + (rows[each, k] >= value[node]))
            total += length[node]
        return 2.0 ** -(total / len(self.feature) / max(1e-9, float(usual_path(self.points))))

    def calibrate(self, clean: np.ndarray, poor: np.ndarray, clean_weight: float) -> None:
        """The threshold with the least cost, a lost clean row counting ``clean_weight`` times; in the middle of its gap."""
        if not len(poor):
            self.threshold = float(clean.max(initial=0.0)) + 1e-9 if len(clean) else math.inf
            return
        cuts = np.unique(np.r_[clean, poor])
        cuts = np.r_[cuts[0] - 1, (cuts[1:] + cuts[:-1]) / 2, cuts[-1] + 1]
        lost = len(clean) - np.searchsorted(np.sort(clean), cuts, side="right")
        passed = np.searchsorted(np.sort(poor), cuts, side="right")
        cost = clean_weight * lost + passed
        self.threshold = float(cuts[np.flatnonzero(cost == cost.min())[-1]])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = 20_000, min_words: int = 50, max_repeat: int = 50, trees: int = 100, points: int = 256, margin: float = 0.15, clean_weight: float = 50.0, seed: int = 5) -> IsolationForest | None:
    """A calibrated forest, or None where no clean labelled row passes the base rules.

    The broadcast side has ``fit_rows`` ids at most; as many rows of numbers reach the driver.
    """
    sample = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id")).limit(fit_rows)
    chosen = id_text(docs, id_col, text_col).join(F.broadcast(sample), "doc_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, 1 << 20):
            s = statistics(part.column("text"))
            fine = ~base_failed(s, min_words, max_repeat)
            rows = features(s)[fine]
            if len(rows):
                yield pa.RecordBatch.from_arrays([part.column("doc_id").filter(pa.array(fine)), pa.array(part.column("quality").to_numpy(zero_copy_only=False)[fine].astype(np.int32)), pa.array(rows.tolist(), pa.list_(pa.float64()))], ["doc_id", "quality", "features"])

    found = chosen.select("doc_id", F.col("quality").cast("int").alias("quality"), "text").mapInArrow(measure, "doc_id long, quality int, features array<double>").toPandas().sort_values("doc_id")
    clean, poor = (np.array(found.features[(found.quality > 0) == x].tolist()).reshape(-1, 7) for x in (True, False))
    if len(clean) < 2:
        return None
    forest = IsolationForest.grow(clean[::2], trees, points, margin, seed)
    forest.calibrate(forest.score(clean[1::2]), forest.score(poor), clean_weight)
    return forest


def judged(batch_text: pa.Array, forest: IsolationForest | None, min_words: int, max_repeat: int) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    s = statistics(batch_text)
    failed = base_failed(s, min_words, max_repeat)
    score = forest.score(features(s)) if forest else np.zeros(len(failed))
    return s, failed, score, ~failed & (score <= (forest.threshold if forest else math.inf))


RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat: int = 50, **fit_options) -> DataFrame:
    """Statistics, score and verdict of every row.

    Null and empty texts have no words and fail the base rules; null ids and repeated rows
    are judged like others; an empty table gives an empty result; without usable labels
    the base rules decide alone. Other columns are ignored.
    """
    forest = fit(docs, labels, id_col=id_col, text_col=text_col, min_words=min_words, max_repeat=max_repeat, **fit_options)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, 1 << 20):
            s, failed, score, kept = judged(part.column("text"), forest, min_words, max_repeat)
            names = COUNTS[:5]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(s[k].astype(np.int64)) for k in names), pa.array(failed), pa.array(kept), pa.array(score)], ["doc_id", *names, "base_failed", "kept", "score"])

    return id_text(docs, id_col, text_col).mapInArrow(rows, RESULT)


def kept(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat: int = 50, **fit_options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that pass the base rules and the forest."""
    session.prepare(docs.sparkSession)
    forest = fit(docs, labels, id_col=id_col, text_col=text_col, min_words=min_words, max_repeat=max_repeat, **fit_options)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, 1 << 20, text_col):
            text = part.column(text_col).fill_null("")
            yield part.filter(pa.array(judged(text, forest, min_words, max_repeat)[3]))

    return docs.mapInArrow(rows, docs.schema)
