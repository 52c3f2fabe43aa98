"""Vectors from a service, in batches with retries and isolation of bad rows; a deterministic stand-in needs no service."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lodestone import session

Embed = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def hashed_words(texts: Sequence[str], dim: int = 64) -> list[list[float]]:
    """Unit vectors of signed word hashes: equal texts have equal vectors, common words bring texts closer."""
    out = []
    for text in texts:
        v = np.zeros(dim)
        for word in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            v[h % dim] += 1 if h >> 40 & 1 else -1
        norm = np.linalg.norm(v)
        out.append((v / norm if norm else v).tolist())
    return out


def embed_batch(texts: Sequence[str], embed: Embed, attempts: int = 2) -> list[tuple[list[float] | None, str | None]]:
    """(vector, error) of each text: the whole batch first, then one by one so that a bad text fails alone."""
    for _ in range(attempts):
        try:
            return [(list(v), None) for v in embed(texts)]
        except Exception as error:  # a service may fail in any way
            reason = str(error)[:300]
    out: list[tuple[list[float] | None, str | None]] = []
    for text in texts:
        try:
            out.append((list(embed([text])[0]), None))
        except Exception as error:
            out.append((None, str(error)[:300] or reason))
    return out


def embedded(chunks: DataFrame, embed: Embed = hashed_words, batch: int = 32) -> DataFrame:
    """Chunks with ``embedding`` and ``error`` (SEARCH-003 and the reason) where no vector came."""
    session.prepare(chunks.sparkSession)
    rest = [c for c in chunks.columns if c not in ("embedding", "error")]
    kept = chunks.select(*rest)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].fillna("").tolist()
            found = [x for at in range(0, len(texts), batch) for x in embed_batch(texts[at : at + batch], embed)]
            yield frame.assign(embedding=[v for v, _ in found], reason=[e for _, e in found])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    out = kept.mapInPandas(run, f"{schema}, embedding array<float>, reason string")
    error = F.when(F.col("reason").isNotNull(), F.struct(F.lit("SEARCH-003").alias("code"), "reason"))
    return out.withColumn("error", error).drop("reason")
