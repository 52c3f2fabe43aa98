"""SentencePiece (merge type) encoding and decoding by a prefix table.

For every prefix of a word there is exactly one token with which the encoding of that
prefix ends. The table stores it: an automaton gives the vocabulary entries that end at a
position, and an entry is the right one if the two tokens at the seam - the last token of
the shorter prefix and the entry - survive merging side by side. Ids are then read
backwards through the table. No queue of merges runs over the text.

Why the test on neighbours is enough: up to the first merge across a seam the tokens on
its two sides evolve as they would alone, so a sequence is the encoding of its text if and
only if each pair of neighbours is the encoding of theirs.

The vocabulary has no entry in which the blank mark follows another character or anything
but a letter follows a letter, and no entry with a line feed, so texts are cut there;
words are looked up in a bounded per-worker table first.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.arrowtext import by_bytes, id_text, record

MARK = "▁"
#: Letters that are always words' letters here: Latin, Greek, Cyrillic.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏͰ-ϿЀ-ԯ"
LETTER = f"[{_LETTERS}]"
OTHER = f"[^{_LETTERS}{MARK}\n]"
WORDS = re.compile(rf"{MARK}*{OTHER}*{LETTER}+|{MARK}*{OTHER}+|{MARK}+|\n")

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


class PieceCodec:
    """Encoder and decoder for one merge-type model with byte fallback, dummy prefix and no normalisation."""

    def __init__(self, model_path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model_path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte_ids = {int(p[1:-1], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.silent = {i for i in range(len(self.pieces)) if sp.is_control(i)}
        self.unknown = sp.unk_id()
        normal = [i for i in range(len(self.pieces)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id_of = {self.pieces[i]: i for i in normal}
        order = sorted((i for i in normal if len(self.pieces[i]) > 1), key=lambda i: (-sp.get_score(i), i))
        self.rank = [0] * len(self.pieces)  # of the merge that makes a piece; 0: a character
        for n, i in enumerate(order, 1):
            self.rank[i] = n
        self.splits: dict[int, tuple[int, int] | None] = {}
        if any(MARK in p.lstrip(MARK) or "\n" in p or re.search(rf"{LETTER}(?!{LETTER}|$)", p) for p in self.id_of):
            raise ValueError("the model has entries across word boundaries")
        self.chars = {c for c in self.id_of if len(c) == 1}
        self.automaton = ahocorasick.Automaton()
        for piece in self.id_of:
            self.automaton.add_word(piece, (len(piece) - 1, self.id_of[piece]))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.sizes = [len(p) for p in self.pieces]

    def halves(self, piece: int) -> tuple[int, int] | None:
        """The two tokens that merge last when the piece's characters merge alone; None for a single character.

        Best score first, leftmost among equals; (-1, -1) if they don't end as the piece.
        """
        text = self.pieces[piece]
        if len(text) == 1:
            return None
        parts: list[str | None] = list(text)
        left, right = [i - 1 for i in range(len(parts))], [i + 1 for i in range(len(parts))]
        queue: list[tuple[int, int, int, str]] = []
        last = ("", "")

        def propose(i: int, j: int) -> None:
            if i >= 0 and j < len(parts) and (joined := parts[i] + parts[j]) in self.id_of:
                heapq.heappush(queue, (self.rank[self.id_of[joined]], i, j, joined))

        for i in range(len(parts) - 1):
            propose(i, i + 1)
        while queue:
            _, i, j, joined = heapq.heappop(queue)
            if parts[i] is None or parts[j] is None or parts[i] + parts[j] != joined or right[i] != j:
                continue
            last = (parts[i], parts[j])
            parts[i], parts[j], right[i] = joined, None, right[j]
            if right[i] < len(parts):
                left[right[i]] = i
            propose(left[i], i)
            propose(i, right[i])
        return (self.id_of[last[0]], self.id_of[last[1]]) if parts[0] == text else (-1, -1)

    def split(self, piece: int) -> tuple[int, int] | None:
        if piece not in self.splits:
            self.splits[piece] = self.halves(piece)
        return self.splits[piece]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging side by side leaves tokens a and b whole (a = -1: only whether b merges to itself).

        Undo the later of the two last merges again and again; at each step the parts at
        the seam must not form an entry that would have merged before the step's merge.
        """
        if self.split(b) == (-1, -1) or a >= 0 and self.split(a) == (-1, -1):
            return False
        if a < 0:
            return True
        rank, pieces, get, limit = self.rank, self.pieces, self.id_of.get, 1 << 40
        while True:
            joined = get(pieces[a] + pieces[b])
            # Twice the rank, so that "before, or at the same rank further left" is one comparison.
            if joined is not None and 2 * rank[joined] < limit:
                return False
            if rank[a] <= 0 and rank[b] <= 0:
                return True
            if rank[a] > rank[b]:
                limit = 2 * rank[a]
                a = self.split(a)[1]
            else:
                limit = 2 * rank[b] + 1
                b = self.split(b)[0]

    def fit(self, before: int, piece: int) -> bool:
        """``compatible``, remembered."""
        if len(self.fits) >= 1_000_000:
            self.fits.clear()
        known = self.fits[before << 20 | piece] = self.compatible(before, piece)
        return known

    def encode_word(self, word: str) -> list[int]:
        """Ids of a word (no cut is inside it): characters outside the vocabulary give byte ids."""
        ids: list[int] = []
        at = 0
        while at < len(word):
            to = at
            while to < len(word) and word[to] in self.chars:
                to += 1
            if to > at:
                ids += self.table_ids(word[at:to])
            if to < len(word):
                ids += [self.byte_ids[b] for b in word[to].encode()]
            at = to + 1
        return ids

    def table_ids(self, word: str) -> list[int]:
        last: list[int | None] = [None] * len(word) + [-1]  # the entry at -1 is that of the empty prefix
        fits, fit = self.fits, self.fit
        for end, (size, piece) in self.automaton.iter(word):
            if last[end] is None:
                before = last[end - size - 1]
                if (known := fits.get(before << 20 | piece)) or known is None and fit(before, piece):
                    last[end] = piece
        ids, at, sizes = [], len(word) - 1, self.sizes
        while at >= 0:
            ids.append(piece := last[at])
            at -= sizes[piece]
        return ids[::-1]

    def words(self, text: str) -> list[str]:
        return WORDS.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for word in self.words(text) for i in self.encode_word(word)]

    def surface(self, ids: list[int]) -> str:
        """The text of ids before the dummy prefix goes: bytes in a row form UTF-8, control ids nothing."""
        out, run = [], bytearray()
        byte_of = self.byte_of
        for i in ids:
            if i in byte_of:
                run.append(byte_of[i])
                continue
            if run:
                out.append(run.decode(errors="replace"))
                run.clear()
            out.append("" if i in self.silent else " ⁇ " if i == self.unknown else self.pieces[i].replace(MARK, " "))
        return "".join(out) + run.decode(errors="replace")

    def decode(self, ids: list[int]) -> str:
        text = self.surface(ids)
        return text[1:] if text.startswith(" ") else text


class WordTable:
    """Ids (as text) and surfaces of words met lately: two generations, of which the older goes when the newer is full."""

    def __init__(self):
        self.ids: dict[str, str] = {}
        self.surfaces: dict[str, str] = {}
        self.older: tuple[dict, dict] = ({}, {})

    def learn(self, words: set[str], codec: PieceCodec, limit: int) -> None:
        new = words.difference(self.ids)
        if len(self.ids) + len(new) > limit:
            self.older, self.ids, self.surfaces = (self.ids, self.surfaces), {}, {}
            new = words
        old_ids, old_surfaces = self.older
        for word in new:
            text = old_ids.get(word)
            if text is None:
                ids = codec.encode_word(word)
                self.ids[word], self.surfaces[word] = ",".join(map(str, ids)), codec.surface(ids)
            else:
                self.ids[word], self.surfaces[word] = text, old_surfaces[word]


_loaded: dict[str, tuple[PieceCodec, WordTable]] = {}


def load(path: str) -> tuple[PieceCodec, WordTable]:
    if path not in _loaded:
        _loaded[path] = (PieceCodec(path), WordTable())
    return _loaded[path]


def coded(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 20, table_limit: int = 250_000, digests: bool = False) -> DataFrame:
    """Per row: id, token count, and ids with the decoded text - or, with ``digests``, their SHA-256.

    Null and empty texts have no ids and decode to the empty text. Repeated rows and null
    ids stay; an empty table gives an empty result; other columns are ignored.
    """
    schema = SCHEMA if digests else pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, table = load(model_path)
        for part in by_bytes(batches, batch_bytes):
            words = [codec.words(text) for text in part.column("text").to_pylist()]
            table.learn(set().union(*words), codec, table_limit)
            ids = [",".join(map(table.ids.__getitem__, ws)) for ws in words]
            texts = ["".join(map(table.surfaces.__getitem__, ws)) for ws in words]
            texts = [t[1:] if t.startswith(" ") else t for t in texts]
            if digests:
                second = [hashlib.sha256(x.encode()).hexdigest() for x in ids]
                texts = [hashlib.sha256(x.encode()).hexdigest() for x in texts]
            else:
                second = [[int(i) for i in x.split(",")] if x else [] for x in ids]
            yield record(schema, part.column("doc_id"), [x.count(",") + 1 if x else 0 for x in ids], second, texts)

    kinds = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return id_text(docs, id_col, text_col).mapInArrow(rows, f"doc_id long, n_tokens long, {kinds}")
