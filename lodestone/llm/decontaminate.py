"""Benchmark decontamination: items found in documents up to a share of word edits.

Words are lower-cased runs of letters and digits. The CGK random walk copies a word
sequence into a longer one, standing still or stepping on by a coin that depends on the step
and the word, so a few edits become few differing places. Each table has a walk of its own
and samples ``bits`` places of it, where walks haven't reached the end, as its key. Items of
one length share an index of their keys in all tables, in which windows of that length are
looked up; what they meet are the candidates, verified by exact edit distance.

The number of tables is set for each item from edited copies of it, so that a window with the
most edits allowed is met with probability ``recall``; a length has as many as its neediest
item. An item that would need more than ``max_tables`` isn't left to chance: it is
verified at every window that is looked up for its length.

Windows are looked up only where any item of their length can be: by the q-gram lemma a
window within e edits of an item of m words shares all but 2 e of its different word pairs.
The count is over the pairs of all items of that length together, so it says nothing about
which item it may be, and it loses nothing.
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
from lodestone.llm.staging import joined_bytes

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def word_ids(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the n + 1 offsets of the texts in them."""
    raw, offsets = joined_bytes([t.lower().encode() for t in texts])
    starts, ends, rows = rolling.word_spans(raw, offsets, _WORD[raw])
    return rolling.word_hashes(raw, starts, ends, 41), rows


def pair_hashes(words: np.ndarray) -> np.ndarray:
    return rolling.window_hash(rolling.prefix_sums(words, 42), 42, 2)


#: Of a walk over m words the places up to this many times m are sampled; a walk is at half its steps' number, so they lie inside.
REACH = 1.6


def steps(windows: np.ndarray, walks: np.ndarray, last: int, lasts: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Place by place, the words that each walk (a row) copies from each window (a row of ``windows``); 0 stands behind the end.

    ``lasts``: the last place that is wanted of each walk, in descending order; walks past it are left out.
    """
    rows, m = windows.shape
    padded = np.c_[windows, np.zeros(rows, np.uint64)].ravel()
    end = np.arange(rows) * (m + 1) + m
    at, salt = np.tile(end - m, (len(walks), 1)), walks[:, None] * np.uint64(2) + np.uint64(1)
    going = np.searchsorted(-lasts, -np.arange(last), side="right") if lasts is not None else np.full(last, len(walks))
    for j, n in enumerate(going.tolist()):
        at, salt = at[:n], salt[:n]
        here = padded[at]
        yield here
        at += (rolling.mix_in_place(here ^ (salt + np.uint64(2 * j))) & np.uint64(1)).view(np.int64)
        np.minimum(at, end, out=at)


def walk(windows: np.ndarray, seed: int) -> np.ndarray:
    """CGK embedding of equally long word sequences, one a row."""
    start = np.array([seed], np.uint64) * np.uint64(1_000_003)
    return np.stack([here[0] for here in steps(windows, start, int(REACH * windows.shape[1]))], axis=1)


def edited(words: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """A copy after random edits, filled up or cut to its old length as a window would be."""
    out = list(words)
    for _ in range(edits):
        kind, at = int(rng.integers(3)), int(rng.integers(max(1, len(out))))
        out[at : at + (kind != 1)] = [] if kind == 2 else [np.uint64(rng.integers(1 << 62))]
    out += [np.uint64(x) for x in rng.integers(1 << 62, size=max(0, len(words) - len(out)))]
    return np.array(out[: len(words)], np.uint64)


def tables_needed(words: np.ndarray, edits: int, bits: int, recall: float, seed: int, copies: int = 24, walks: int = 16) -> int:
    """Tables after which copies of an item with this many edits are met with probability ``recall``, on average over copies."""
    rng = np.random.default_rng((seed, len(words)))
    windows = np.stack([words, *(edited(words, edits, rng) for _ in range(copies))])
    equal = np.stack([here[:, 1:] == here[:, :1] for here in steps(windows, np.arange(1, walks + 1, dtype=np.uint64) * np.uint64(7_368_787), int(REACH * len(words)))])
    met = (equal.mean(axis=0) ** bits).mean(axis=0)  # of a table, by copy
    low, high = 1, 1 << 20
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if (1 - (1 - met) ** middle).mean() >= recall else (middle + 1, high)
    return low


@dataclass
class Length:
    """The index of the items of one length."""

    m: int
    edits: int
    items: list[int]  # numbers of the items
    need: int  # pairs that a window close to any of them shares with them at least
    mask: np.ndarray  # which of all pairs are theirs
    tables: int
    places: np.ndarray  # tables x bits
    walks: np.ndarray
    direct: list[int]  # items that no affordable number of tables would find
    keys: np.ndarray | None = None  # sorted, of all items in all tables
    owner: np.ndarray | None = None

    def key(self, windows: np.ndarray) -> np.ndarray:
        """Keys (tables x windows)."""
        lasts = self.places.max(axis=1)
        order = np.argsort(-lasts, kind="stable")
        places, walks = self.places[order], self.walks[order]
        held = np.repeat(walks[:, None], len(windows), axis=1)
        for j, here in enumerate(steps(windows, walks, int(lasts.max()) + 1, lasts[order])):
            for k in range(places.shape[1]):
                mine = np.flatnonzero(places[:, k] == j)
                if len(mine):
                    held[mine] = rolling.mix(held[mine] + here[mine] + np.uint64(k * 7919 + 1))
        key = np.empty_like(held)
        key[order] = held
        return key

    def look_up(self, windows: np.ndarray, chunk: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all that meet in a table, and of the direct items everywhere."""
        found = [(np.repeat(np.arange(len(windows)), len(self.direct)), np.tile(np.array(self.direct, np.int64), len(windows)))]
        for a in range(0, len(windows), chunk) if self.tables else ():
            some = self.key(windows[a : a + chunk])
            first, last = (np.searchsorted(self.keys, some.ravel(), side=side) for side in ("left", "right"))
            hit = np.flatnonzero(last > first)
            count = (last - first)[hit]
            each = np.repeat(hit, count)
            at = first[each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
            found.append((a + each % some.shape[1], self.owner[at]))
        window, item = (np.concatenate(x) for x in zip(*found))
        code = np.unique(window * (1 << 32) + item)
        return code >> 32, code & 0xFFFFFFFF


@dataclass
class Plan:
    """What executors need of a bounded set of items."""

    ids: list[int]
    words: list[np.ndarray]
    pairs: np.ndarray  # hashes of all items' word pairs, in order
    lengths: list[Length]

    @classmethod
    def of(cls, items: list[tuple[int, str]], rate: float, min_words: int, bits: int, recall: float, max_tables: int, seed: int) -> Plan:
        words, rows = word_ids([t for _, t in items])
        kept = [(i, words[a:b]) for (i, _), a, b in zip(items, rows, rows[1:]) if b - a >= min_words]
        own = [pair_hashes(w) for _, w in kept]
        pairs = np.unique(np.concatenate(own)) if own else np.empty(0, np.uint64)
        by_length: dict[int, list[int]] = {}
        for n, (_, w) in enumerate(kept):
            by_length.setdefault(len(w), []).append(n)
        plan = cls([i for i, _ in kept], [w for _, w in kept], pairs, [])
        for m, numbers in sorted(by_length.items()):
            edits = int(rate * m)
            # An edit breaks two pairs at most; a window may begin inside a run of one pair, which costs one more.
            need = max(1, min(len(np.unique(own[n])) for n in numbers) - 2 * edits - 1)
            wanted = {n: tables_needed(plan.words[n], max(1, edits), bits, recall, seed) for n in numbers}
            direct = [n for n in numbers if wanted[n] > max_tables]
            tables = max((t for t in wanted.values() if t <= max_tables), default=0)
            places = np.random.default_rng((seed, m)).integers(int(REACH * m), size=(tables, bits))
            walks = (np.arange(tables, dtype=np.uint64) + np.uint64(seed + 1)) * np.uint64(1_000_003)
            index = Length(m, edits, numbers, need, np.isin(pairs, np.concatenate([own[n] for n in numbers])), tables, places, walks, direct)
            looked = [n for n in numbers if n not in set(direct)]
            if looked:
                key = index.key(np.stack([plan.words[n] for n in looked]))
                order = np.argsort(key, axis=None)
                index.keys, index.owner = key.ravel()[order], np.tile(np.array(looked, np.int64), tables)[order]
            plan.lengths.append(index)
        return plan

    def find(self, words: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item id, edits, start, end): the best place of every item in each of several documents."""
        grams = pair_hashes(words)
        if not len(grams) or not len(self.pairs):
            return []
        at = np.minimum(np.searchsorted(self.pairs, grams), len(self.pairs) - 1)
        hits = np.flatnonzero((self.pairs[at] == grams) & rolling.inside_rows(rows, len(grams), 2))
        pair, doc, out = at[hits], np.searchsorted(rows, hits, side="right") - 1, []
        for index in self.lengths:
            mine = index.mask[pair]
            windows, docs, starts = self.windows(index, words, rows, hits[mine], doc[mine])
            if not len(docs):
                continue
            window, item = index.look_up(windows)
            order = np.lexsort((starts[window], item, docs[window]))
            window, item = window[order], item[order]
            first = np.flatnonzero(np.r_[True, (docs[window][1:] != docs[window][:-1]) | (item[1:] != item[:-1])]) if len(window) else []
            for a, b in zip(first, [*first[1:], len(window)]):
                d, n = int(docs[window[a]]), int(item[a])
                own, best = words[rows[d] : rows[d + 1]], None
                for x, y in regions(starts[window[a:b]], index.m, index.edits, len(own)):
                    edits, end = closest(self.words[n], own[x:y])
                    if edits <= index.edits and (best is None or edits < best[2]):
                        best = (d, self.ids[n], edits, max(0, x + end - index.m), x + end)
                if best:
                    out.append(best)
        return sorted(out)

    def windows(self, index: Length, words: np.ndarray, rows: np.ndarray, hits: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows with enough pairs in and about them, their documents, and where they start in those (from ``edits`` words before on)."""
        m, e, need = index.m, index.edits, index.need
        held, docs, starts = [], [], []
        ahead = np.flatnonzero((hits[need - 1 :] - hits[: len(hits) - need + 1] <= m + 2 * e) & (doc[need - 1 :] == doc[: len(doc) - need + 1])) if len(hits) >= need else []
        for d in np.unique(doc[ahead]) if len(ahead) else ():
            own = words[rows[d] : rows[d + 1]]
            sums = np.r_[0, np.cumsum(np.bincount(hits[slice(*np.searchsorted(doc, [d, d + 1]))] - rows[d], minlength=len(own) + 1))]
            s = np.arange(-e, max(1, len(own) - m + e + 1))
            s = s[sums[np.clip(s + m + e, 0, len(own))] - sums[np.clip(s - e, 0, len(own))] >= need]
            padded = np.r_[np.zeros(e, np.uint64), own, np.zeros(m + e, np.uint64)]
            held.append(padded[(s + e)[:, None] + np.arange(m)])
            docs.append(np.full(len(s), d))
            starts.append(s)
        if not held:
            return np.empty((0, m), np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(held), np.concatenate(docs), np.concatenate(starts)


def regions(starts: np.ndarray, m: int, e: int, n: int) -> list[tuple[int, int]]:
    """Stretches of words that the windows at ``starts`` and their surroundings cover."""
    out: list[tuple[int, int]] = []
    for s in starts.tolist():
        a, b = max(0, s - e), min(n, s + m + e)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def closest(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Least edits from ``item`` to any stretch of ``words``, and where that stretch ends."""
    # Myers: a bit for each row of the table of edits, set where a value is one more (or less) than the one above it.
    bits: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        bits[w] = bits.get(w, 0) | 1 << i
    edits = len(item)
    full, top = (1 << edits) - 1, 1 << edits >> 1
    more, less, best = full, 0, (edits, 0)
    for end, word in enumerate(words.tolist(), 1):
        same = bits.get(word, 0)
        across = ((same & more) + more ^ more) | same
        up, down = less | full & ~(across | more), more & across
        edits += bool(up & top) - bool(down & top)
        up, down, down_or_same = up << 1 & full, down << 1 & full, same | less
        more, less = down | full & ~(down_or_same | up), up & down_or_same
        if edits < best[0]:
            best = (edits, end)
    return best


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = 0.2, min_words: int = 5, bits: int = 2, recall: float = 0.999, max_tables: int = 512, items_at_once: int = 20_000, seed: int = 9) -> DataFrame:
    """(doc_id, item_id, edits, start_word, end_word) for every item that a document holds within ``rate`` edits a word.

    Items with fewer than ``min_words`` words, null items and null texts match nothing;
    a document or item that is repeated gives its rows again. Rows without an id match
    like others. Empty tables give an empty result; other columns are ignored. Executors
    get ``items_at_once`` items at a time; more items are taken in several passes.
    """
    spark = session.prepare(docs.sparkSession)
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).filter("text is not null")
    passes = max(1, math.ceil(items.count() / items_at_once))
    rows, found = id_text(docs, id_col, text_col), None
    for n in range(passes):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == n).orderBy("item_id", "text")
        plan = spark.sparkContext.broadcast(Plan.of([(r.item_id, r.text) for r in mine.collect()], rate, min_words, bits, recall, max_tables, seed))

        def search(batches: Iterator[pa.RecordBatch], plan=plan) -> Iterator[pa.RecordBatch]:
            p = plan.value
            for part in by_bytes(batches, 1 << 20):
                words, offsets = word_ids(part.column("text").to_pylist())
                ids = part.column("doc_id").to_pylist()
                out = [(ids[d], *hit) for d, *hit in p.find(words, offsets)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(5)], ["doc_id", "item_id", "edits", "start_word", "end_word"])

        one = rows.mapInArrow(search, "doc_id long, item_id long, edits long, start_word long, end_word long")
        found = one if found is None else found.unionByName(one)
    return found
