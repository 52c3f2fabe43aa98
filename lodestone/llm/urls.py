"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest.

Trees are fitted to a bounded sample of labelled URLs (``fit_rows``, by hash of the URL);
the block rates of host suffixes, one of the features, count all labelled URLs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lodestone import session

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """(page_id, url, host, path): both empty for a null URL or one without ``://``."""
    url = F.col(url_col)
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host.alias("host"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"))


def rule_column(rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """Rule and its verdict (null where none fits): the longest rule that fits the host, or one above it, and the path's start."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # Least first, so that a later one overrides: shorter before longer, allow before block.
    for action, text in sorted(rules, key=lambda r: (len(r[1]), r[0], r[1])):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def suffix() -> Column:
    """The last two labels of the host."""
    return F.regexp_extract("host", r"([^.]*\.?[^.]*)$", 1)


def lexical(urls: list[str], rates: np.ndarray) -> np.ndarray:
    """Length, depth, digit ratio, entropy, parameters, hyphens, dots, longest digit run's share, and the suffix's block rate."""
    out = np.zeros((len(urls), 8))
    for i, url in enumerate(urls):
        raw = np.frombuffer(url.encode(), np.uint8)
        n = max(1, len(raw))
        counts = np.bincount(raw, minlength=1)
        share = counts[counts > 0] / n
        digits = int(((raw >= 48) & (raw <= 57)).sum())
        out[i, :7] = n, url.count("/"), digits / n, -(share * np.log2(share)).sum() if len(raw) else 0.0, url.count("&") + url.count("?"), url.count("-"), url.count(".")
    out[:, 7] = rates
    return out


@dataclass
class BoostedTrees:
    """Depth-limited trees by Newton steps on the logistic loss, over cut points at quantiles."""

    rounds: int = 40
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    ridge: float = 1.0
    bias: float = 0.0
    trees: list[list[tuple[int, float, float]]] = field(default_factory=list)  # node: feature (-1: leaf), cut, value

    def fit(self, rows: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = np.clip(y.mean(), 0.01, 0.99)
        self.bias = float(np.log(share / (1 - share)))
        cuts = [np.unique(np.quantile(rows[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) for k in range(rows.shape[1])]
        margin = np.full(len(rows), self.bias)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = y - p, p * (1 - p)
            tree: list[tuple[int, float, float]] = [(-1, 0.0, 0.0)] * (2 ** (self.depth + 1) - 1)
            where = np.zeros(len(rows), np.int64)
            for node in range(len(tree)):
                here = np.flatnonzero(where == node)
                if not len(here):
                    continue
                g, h = grad[here], hess[here]
                best = (1e-6, -1, 0.0)
                if node < 2**self.depth - 1:
                    for k, points in enumerate(cuts):
                        if not len(points):
                            continue
                        at = np.searchsorted(points, rows[here, k], side="left")
                        gl, hl = (np.cumsum(np.bincount(at, w, len(points) + 1))[:-1] for w in (g, h))
                        gain = gl**2 / (hl + self.ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + self.ridge) - g.sum() ** 2 / (h.sum() + self.ridge)
                        if gain.max() > best[0]:
                            best = (float(gain.max()), k, float(points[gain.argmax()]))
                if best[1] < 0:
                    tree[node] = (-1, 0.0, float(self.rate * g.sum() / (h.sum() + self.ridge)))
                else:
                    tree[node] = (best[1], best[2], 0.0)
                    where[here] = 2 * node + 1 + (rows[here, best[1]] > best[2])
            self.trees.append(tree)
            margin += self.tree_values(tree, rows)
        return self

    def tree_values(self, tree: list[tuple[int, float, float]], rows: np.ndarray) -> np.ndarray:
        feature, cut, value = (np.array(x) for x in zip(*tree))
        node, each = np.zeros(len(rows), np.int64), np.arange(len(rows))
        for _ in range(self.depth):
            k = feature[node]
            node = np.where(k < 0, node, 2 * node + 1 + (rows[each, k] > cut[node]))
        return value[node]

    def probability(self, rows: np.ndarray) -> np.ndarray:
        margin = np.full(len(rows), self.bias)
        for tree in self.trees:
            margin += self.tree_values(tree, rows)
        return 1 / (1 + np.exp(-margin))


def ruled(pages: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(url, label): URLs that rules decide, as labelled ones."""
    _, verdict = rule_column(rules)
    return with_parts(pages, id_col, url_col).select("url", verdict.alias("label")).filter("label is not null")


def held_out(labelled: DataFrame, percent: int = 20, **given) -> DataFrame:
    """How the trees do on labelled URLs that they haven't seen: (label, verdict, n).

    A URL is held out by its hash, so repeated ones are all on one side. ``given`` goes to ``judge``.
    """
    side = F.pmod(F.xxhash64("url"), F.lit(100)) < percent
    asked = labelled.filter(side).select(F.struct("url", "label").alias("page_id"), "url")
    found = judge(asked, (), labelled.filter(~side), **given)
    return found.groupBy(F.col("page_id.label").alias("label"), "verdict").agg(F.count(F.lit(1)).alias("n"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], labelled: DataFrame | None = None, *, id_col: str = "page_id", url_col: str = "url", fit_rows: int = 20_000, most_broadcast: int = 100_000, threshold: float = 0.5) -> DataFrame:
    """Per page: host, path, rule (or null), block score of the trees, verdict (the rule's, else the trees').

    ``labelled`` has url and label (allow or block); without it the URLs that rules decide
    are the labelled ones. Null URLs have empty parts and are judged by the trees; repeated
    rows stay; an empty table gives an empty result; without labels of both kinds what no
    rule decides is allowed. Other columns are ignored.
    """
    spark = session.prepare(pages.sparkSession)
    rule, verdict = rule_column(rules)
    parts = with_parts(pages, id_col, url_col).withColumn("rule", rule).withColumn("ruled", verdict).withColumn("suffix", suffix())
    if labelled is None:
        known = parts.filter("ruled is not null").select("url", "suffix", (F.col("ruled") == "block").cast("int").alias("y"))
    else:
        known = with_parts(labelled.withColumn("y", (F.col("label") == "block").cast("int")), "y", "url").select("url", suffix().alias("suffix"), F.col("page_id").alias("y")).filter("url is not null and y is not null")
    rates = known.groupBy("suffix").agg(((F.sum("y") + 1.0) / (F.count("y") + 2.0)).alias("suffix_rate"))
    few = rates.limit(most_broadcast + 1).count() <= most_broadcast
    rates = F.broadcast(rates) if few else rates.hint("merge")
    sample = known.distinct().orderBy(F.xxhash64("url"), "url").limit(fit_rows).join(rates, "suffix", "left").orderBy("url", "y").toPandas()
    trees = None
    if len(sample) and 0 < sample.y.sum() < len(sample):
        trees = spark.sparkContext.broadcast(BoostedTrees().fit(lexical(sample.url.tolist(), sample.suffix_rate.to_numpy(float)), sample.y.to_numpy(float)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = lexical(batch.column("url").fill_null("").to_pylist(), batch.column("suffix_rate").to_numpy(zero_copy_only=False))
            block = trees.value.probability(rows) if trees else np.zeros(batch.num_rows)
            ruled = batch.column("ruled").to_pylist()
            final = [r or ("block" if p > threshold else "allow") for r, p in zip(ruled, block)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(final, pa.string()), pa.array(block)], ["page_id", "host", "path", "rule", "verdict", "score"])

    kind = dict(parts.dtypes)["page_id"]
    rated = parts.join(rates, "suffix", "left").fillna(0.5, ["suffix_rate"])
    return rated.select("page_id", "url", "host", "path", "rule", "ruled", "suffix_rate").mapInArrow(score, f"page_id {kind}, host string, path string, rule string, verdict string, score double")
