"""Token ids of a corpus in compressed files, and back.

Documents go in ascending order of id to ranges; a range is written as segments, one row
each: (part, seq, n_docs, n_ids, payload). A payload is self-contained: magic, the
length of the index, the compressed index (ids and token counts of its documents, with a
checksum), then the id stream of ``idcoder``. The rows live in Parquet files, so the files
can be in any store that Spark writes to; ``payload`` can be kept alone as a file.

Texts are cut at blanks and line feeds, and between letters, digits and signs where this
tokenizer never joins. Texts that Latin-1 holds are cut as arrays of bytes, a batch at a
time, and lower-cased first, as the tokenizer does (its normal form leaves them alone);
others by an expression. Distinct pieces that a per-worker table, bounded in bytes, doesn't
hold yet go to the library in batches.
"""

from __future__ import annotations

import codecs
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from lodestone import session
from lodestone.llm import idcoder
from lodestone.llm.arrowtext import by_bytes, id_text, record

PIECES = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[ \n.,])|[^ \n]+")
#: Texts with the start of a special token's string are cut at blanks only.
COARSE = re.compile(r"[^ \n]+")
HEAD = struct.Struct("<4sII")
MAGIC = b"IDS1"
SEGMENT = "part int, seq int, n_docs long, n_ids long, payload binary"
SEGMENT_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])
BACK = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
SUMS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
#: Segments whose first places are sent to all executors at most, at 16 bytes each.
MOST_BROADCAST = 1 << 20

LETTERS = bytes(c for c in range(256) if chr(c).isascii() and chr(c).isalpha() or c >= 0xC0 and c not in (0xD7, 0xF7))
DIGITS = b"0123456789"
SIGNS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c != ord("'"))
BLANKS = b" \n"
LOWER = bytes(c + 32 if c in LETTERS and (c < 0x60 or 0xC0 <= c < 0xDF) else c for c in range(256))
#: Bits by which two neighbours are told apart: those of the left byte, those of the right one. The first four cut: a
#: letter ends before a digit or sign, a digit before all of them, a sign (an apostrophe can begin a token with the
#: letter after it) before a letter or digit. The last two are where blanks end and begin.
ENDS_PIECE, ENDS_BLANK, BEGINS_BLANK = 15, 16, 32


def _sides() -> tuple[bytes, bytes]:
    quote, other = b"'", lambda some: bytes(c for c in range(256) if c not in some)
    rules = ((LETTERS, DIGITS + SIGNS + quote), (DIGITS, LETTERS + DIGITS + SIGNS + quote), (SIGNS, LETTERS + DIGITS), (quote, DIGITS), (BLANKS, other(BLANKS)), (other(BLANKS), BLANKS))
    return tuple(bytes(sum(1 << k for k, rule in enumerate(rules) if c in rule[side]) for c in range(256)) for side in (0, 1))


LEFT, RIGHT = _sides()


def cut(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased pieces of Latin-1 texts, and how many each text has."""
    raw = b"\n" + b"\n".join(texts) + b"\n"
    seam = np.frombuffer(raw.translate(LEFT), np.uint8)[:-1] & np.frombuffer(raw.translate(RIGHT), np.uint8)[1:]
    first = np.flatnonzero(seam & (ENDS_PIECE | ENDS_BLANK))
    last = np.flatnonzero(seam & (ENDS_PIECE | BEGINS_BLANK))
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    counts = np.diff(np.searchsorted(first, ends), prepend=0)
    offsets = np.zeros(len(first) + 1, np.int32)
    np.cumsum(last - first, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(raw.translate(LOWER, BLANKS))]), counts


def latin(text: str) -> bytes | None:
    """A text in Latin-1, or None where that can't hold it or it may hold a special token."""
    if "<|" in text:
        return None
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        return None


def byte_signs() -> str:
    """What byte-level tokenizers write for each byte; blanks stay blanks."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return "".join(chr(b if b in own else next(other)) for b in range(256)).replace("\u0120", " ")


def gather(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` one after another."""
    ends = np.cumsum(count)
    return flat[np.repeat(start - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]


class Pieces:
    """Distinct pieces as bytes, numbered, and the ids of each."""

    def __init__(self, dtype: np.dtype):
        self.keys, self.flat, self.start = pa.array([], pa.binary()), np.zeros(1 << 16, dtype), np.zeros(1 << 14, np.int64)

    def add(self, pieces: pa.Array, counts: np.ndarray, ids: np.ndarray) -> None:
        """Pieces that aren't there yet, and their ids one after another."""
        n, more, at = len(self.keys), len(pieces), int(self.start[len(self.keys)])
        if at + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[:at], np.zeros(at + 2 * len(ids), self.flat.dtype)])
        if n + more >= len(self.start):
            self.start = np.concatenate([self.start[: n + 1], np.zeros(n + 2 * more, np.int64)])
        self.flat[at : at + len(ids)] = ids
        self.start[n + 1 : n + 1 + more] = at + np.cumsum(counts)
        self.keys = pa.concat_arrays([self.keys, pieces])

    def keep(self, n: int) -> None:
        """Only the first ``n`` pieces."""
        self.keys = pa.concat_arrays([self.keys.slice(0, n)])

    def size(self) -> int:
        return self.keys.nbytes + self.flat.nbytes + self.start.nbytes

    def numbers(self, pieces: pa.Array) -> np.ndarray:
        """The number of each piece, -1 where it has none."""
        return pc.fill_null(pc.index_in(pieces, value_set=self.keys), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each number has, and all of them."""
        start = self.start[numbers]
        count = self.start[numbers + 1] - start
        return count, gather(self.flat, start, count)


class IdTable:
    """Ids of pieces met lately: in Latin-1, or a line feed and UTF-8.

    Two generations of ``limit`` bytes each; pieces longer than ``LONG`` bytes aren't kept.
    """

    LONG = 64

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # Words of lower-case letters are one unit each, and their last token says so: the library's model alone takes many at a time.
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.signs = byte_signs()
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.new, self.old, self.short = Pieces(self.dtype), Pieces(self.dtype), 0
        probe = "A's 'Tis x.Y,z(É9a)1é-ßé\nThe B"
        if self.coded([probe], 1 << 20)[1].tolist() != self.tokenizer.encode(probe, add_special_tokens=False).ids:
            raise ValueError("texts can't be cut like this for this tokenizer")

    def of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of some words of lower-case Latin-1 letters has, and all of them."""
        texts = (b" ".join(words[k : k + 64]).decode("latin-1") for k in range(0, len(words), 64))
        coded = self.words.encode_batch_fast([t if t.isascii() else codecs.charmap_decode(t.encode(), "strict", self.signs)[0] for t in texts], add_special_tokens=False)
        ids = np.array([i for e in coded for i in e.ids], np.int64)
        last = np.flatnonzero(self.closes[ids])
        if len(last) != len(words) or len(ids) and last[-1] != len(ids) - 1:
            return self.of_any(words)
        return np.diff(last, prepend=-1), ids

    def of_any(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [p[1:].decode() if p[:1] == b"\n" else p.decode("latin-1") for p in pieces]
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return np.array([len(e) for e in coded], np.int64), np.array([i for e in coded for i in e.ids], np.int64)

    def learn(self, pieces: pa.Array, limit: int) -> np.ndarray:
        """Numbers in ``new`` of distinct pieces, all of which it has until the next call."""
        self.new.keep(self.short)
        if self.new.size() > limit:
            self.old, self.new = self.new, Pieces(self.dtype)
        numbers = self.new.numbers(pieces)
        missing = pieces.filter(pa.array(numbers < 0))
        if len(missing):
            places = self.old.numbers(missing)
            self.new.add(missing.filter(pa.array(places >= 0)), *self.old.ids(places[places >= 0]))
            unknown, words, others, long = missing.filter(pa.array(places < 0)).to_pylist(), [], [], []
            for p in unknown:
                (long if len(p) > self.LONG else others if p.translate(None, LETTERS) else words).append(p)
            for some, ids_of in ((words, self.of_words), (others, self.of_any), (long, self.of_any)):
                self.short = len(self.new.keys)
                for at in range(0, len(some), 20_000):
                    self.new.add(pa.array(some[at : at + 20_000], pa.binary()), *ids_of(some[at : at + 20_000]))
            numbers[numbers < 0] = self.new.numbers(missing)
        return numbers

    def looked_up(self, pieces: pa.Array, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of some pieces has, and all of them."""
        pieces = pieces.dictionary_encode()
        numbers = self.learn(pieces.dictionary, limit)
        return self.new.ids(numbers[pieces.indices.to_numpy()])

    def encode(self, texts: list[str], limit: int) -> list[bytes]:
        """Ids of each text, as little-endian bytes of 16 bits (32 for vocabularies over 65,536)."""
        count, ids = self.coded(texts, limit)
        ends = np.cumsum(count).tolist()
        return [ids[a:b].tobytes() for a, b in zip([0, *ends], ends)]

    def coded(self, texts: list[str], limit: int) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and all of them."""
        as_bytes = [latin(t) for t in texts]
        plain = np.array([b is not None for b in as_bytes], bool)
        coded = []
        if plain.any():
            pieces, counts = cut([b for b in as_bytes if b is not None])
            coded.append((counts, *self.looked_up(pieces, limit)))
        if not plain.all():
            found = [(COARSE if "<|" in t else PIECES).findall(t) for t, p in zip(texts, plain) if not p]
            pieces = pa.array([b"\n" + p.encode() for f in found for p in f], pa.binary())
            coded.append((np.array([len(f) for f in found]), *self.looked_up(pieces, limit)))
        per_text = [np.diff(np.r_[0, np.cumsum(n)][np.r_[0, np.cumsum(counts)]]) for counts, n, _ in coded]
        if len(coded) == 1:
            return per_text[0], coded[0][2]
        total = np.zeros(len(texts), np.int64)
        total[plain], total[~plain] = per_text
        flat = np.concatenate([ids for _, _, ids in coded])
        start = np.zeros(len(texts), np.int64)
        start[plain], start[~plain] = (np.cumsum(n) - n + base for n, base in zip(per_text, (0, len(coded[0][2]))))
        return total, gather(flat, start, total)


_loaded: dict[str, IdTable] = {}


def load(path: str) -> IdTable:
    if path not in _loaded:
        _loaded[path] = IdTable(path)
    return _loaded[path]


def pack_segment(ids: list[int | None], counts: np.ndarray, tokens: np.ndarray, block: int) -> bytes:
    named = np.array([i is not None for i in ids])
    index = np.array([i or 0 for i in ids], "<i8").tobytes() + counts.astype("<i8").tobytes() + named.tobytes()
    pressed = zlib.compress(index, 6)
    return HEAD.pack(MAGIC, len(pressed), zlib.crc32(pressed)) + pressed + idcoder.encode(tokens, block)


def unpack_segment(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Ids of the documents, their token counts, and all token ids."""
    magic, size, check = HEAD.unpack_from(payload)
    pressed = payload[HEAD.size : HEAD.size + size]
    if magic != MAGIC or zlib.crc32(pressed) != check:
        raise ValueError("the segment's index is damaged")
    index = zlib.decompress(pressed)
    n = len(index) // 17
    ids, counts = np.frombuffer(index, "<i8", n), np.frombuffer(index, "<i8", n, 8 * n)
    named = np.frombuffer(index, np.bool_, n, 16 * n)
    return [int(i) if k else None for i, k in zip(ids, named)], counts, idcoder.decode(payload[HEAD.size + size :])


def write(docs: DataFrame, tokenizer_path: str, path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, segment_ids: int = 2_000_000, block: int = 1024, table_bytes: int = 32 << 20) -> None:
    """Encode every whole text, append ``end_id``, and write segments in ascending order of ids.

    Null and empty texts are the end id alone; rows without an id come first; rows that
    repeat an id follow each other; an empty table writes no segment.
    """
    rows = id_text(docs, id_col, text_col)
    n = max(1, rows.rdd.getNumPartitions())

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table, part, seq = load(tokenizer_path), TaskContext.get().partitionId(), 0
        ids, counts, data, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            payload = pack_segment(ids, np.concatenate(counts), np.concatenate(data), block)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([held], pa.int64()), pa.array([payload], pa.binary())], schema=SEGMENT_ARROW)

        for slice_ in by_bytes(batches, 1 << 22):
            n, tokens = table.coded(slice_.column("text").to_pylist(), table_bytes)
            ids += slice_.column("doc_id").to_pylist()
            counts.append(n + 1)
            data.append(np.insert(tokens if end_id <= np.iinfo(tokens.dtype).max else tokens.astype(np.uint32), np.cumsum(n), end_id))
            held += len(data[-1])
            if held >= segment_ids:
                yield flush()
                seq, ids, counts, data, held = seq + 1, [], [], [], 0
        if ids:
            yield flush()

    rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id").mapInArrow(segments, SEGMENT).write.parquet(path)


def read(spark: SparkSession, path: str, digests: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files; ids are 32-bit little-endian, or ``digests``: their ``ids_crc32``."""
    session.prepare(spark)
    files = spark.read.schema(SEGMENT).parquet(path)
    schema = SUMS if digests else BACK

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, payload in zip(batch.column("base").to_pylist(), batch.column("payload")):
                ids, counts, tokens = unpack_segment(payload.as_py())
                ends = np.cumsum(counts)
                data = memoryview(np.ascontiguousarray(tokens.astype("<u4", copy=False))).cast("B")
                at = 0
                while at < len(ids):
                    # About 1 MB of ids at a time, one document at least.
                    to = max(at + 1, int(np.searchsorted(ends, ends[at] + (1 << 18))))
                    each = [data[4 * (e - c) : 4 * e] for e, c in zip(ends[at:to].tolist(), counts[at:to].tolist())]
                    last = [zlib.crc32(x) for x in each] if digests else pa.array(each, pa.binary())
                    yield record(schema, ids[at:to], base + ends[at:to] - counts[at:to], counts[at:to], last)
                    at = to

    # Ids before a segment: those of earlier parts (a row a part) and of earlier segments of its part.
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("of_part"))
    parts = parts.select("part", (F.sum("of_part").over(W.orderBy("part")) - F.col("of_part")).alias("before_part"))
    before = files.select("part", "seq", (F.sum("n_ids").over(W.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("before_seq"))
    base = before.join(parts, "part").select("part", "seq", (F.col("before_part") + F.col("before_seq")).alias("base"))
    base = F.broadcast(base) if files.count() <= MOST_BROADCAST else base.hint("merge")
    # Segments meet their places before they are decoded: compressed ids move, if any.
    found = files.join(base, ["part", "seq"]).select("base", "payload")
    return found.mapInArrow(back, f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digests else 'ids binary'}")
