"""Rolling hashes, word spans and content-chosen anchors over the bytes of an Arrow text column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_TABLES: dict[int, np.ndarray] = {}
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def mix_in_place(x: np.ndarray) -> np.ndarray:
    """``mix`` that overwrites its argument."""
    part = x >> U64(30)
    x ^= part
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= np.right_shift(x, U64(27), out=part)
    x *= U64(0x94D049BB133111EB)
    x ^= np.right_shift(x, U64(31), out=part)
    return x


#: An odd number; its powers serve all hashes, which differ by the values they sum.
BASE = 0x9D39247E33776D41


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers, modulo 2**64, of the base and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n + n // 8, 1 << 16)
        out = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(size, U64(b))
            p[0] = 1
            out.append(np.cumprod(p, dtype=U64))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def byte_values(seed: int) -> np.ndarray:
    if seed not in _TABLES:
        _TABLES[seed] = mix(np.arange(1, 257, dtype=U64) * mix(np.array([seed + 1000], U64)))
    return _TABLES[seed]


def prefix_sums(values: np.ndarray, seed: int) -> np.ndarray:
    """P with P[j] - P[i] = sum of scrambled values[t] * base**t for i <= t < j; seeds make unrelated sums."""
    return _sums(mix(values ^ U64(seed * 0x5851F42D4C957F2D & (1 << 64) - 1)))


def byte_sums(raw: np.ndarray, seed: int) -> np.ndarray:
    return _sums(byte_values(seed)[raw])


def _sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, U64)
    values *= powers(len(values) + 1)[0][: len(values)]
    np.cumsum(values, out=out[1:])
    return out


def span_hash(sums: np.ndarray, seed: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span, the same wherever the span stands; the length counts."""
    inverse = powers(len(sums))[1]
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U64) * U64(0x9E3779B97F4A7C15))


def window_hash(sums: np.ndarray, seed: int, size: int) -> np.ndarray:
    """Hash of the ``size`` values from each position on."""
    n = len(sums) - size
    if n <= 0:
        return np.empty(0, U64)
    return mix((sums[size:] - sums[:n]) * powers(len(sums))[1][:n])


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column without nulls, and the n + 1 offsets of its rows in them."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word (no blank, no byte 9 to 13; or ``inside``), and the n + 1 offsets of the rows in the words."""
    if inside is None:
        inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(raw), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(raw), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    return span_hash(byte_sums(raw, seed), seed, starts, ends)


def owners(grams: np.ndarray, width: int) -> np.ndarray:
    """For each start of ``width`` grams in a row: where the least of them stands (leftmost among equals)."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    if len(grams) >= 1 << 28:
        raise ValueError("a slice holds too many positions")
    low = (grams & ~U64((1 << 28) - 1)) | np.arange(len(grams), dtype=U64)
    size = 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[:n], low[width - size : width - size + n])
    return (low & U64((1 << 28) - 1)).astype(np.int64)


def inside_rows(offsets: np.ndarray, n: int, size: int) -> np.ndarray:
    """Of the positions 0..n-1: whether ``size`` values from there on lie in one row."""
    room = np.repeat(offsets[1:], np.diff(offsets))[:n] - np.arange(n)
    return room >= size


def repeats(*keys: np.ndarray) -> np.ndarray:
    """Rows that follow another one with the same first two keys in the order of the others."""
    by = np.lexsort(keys[::-1])
    same = np.r_[False, (keys[0][by][1:] == keys[0][by][:-1]) & (keys[1][by][1:] == keys[1][by][:-1])]
    out = np.zeros(len(by), bool)
    out[by] = same
    return out
