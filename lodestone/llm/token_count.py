"""Token counts: batch encoding inside Arrow functions that return lengths only.

Texts are cut at boundaries where the tokenizer can't join what stands on the two
sides (a blank or line feed after a character that isn't white space), so a text of
any length is a list of pieces; long pieces without blanks are cut further where letters,
digits and signs meet. Distinct pieces of a byte-balanced batch that a per-worker table,
bounded in bytes, doesn't hold yet go to the library in one batch call; everything else is
a table lookup. Only a run of letters, of digits or of signs has no safe boundary inside. The counts equal those of the whole text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lodestone.llm.arrowtext import by_bytes, id_text, record

#: White space of any kind, then a word; odd white space in front of a blank stays inside the piece.
PIECES = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")

#: Longer pieces are cut where classes of characters meet, and their lengths aren't kept.
LONG = 256
SIGNS = r"!-/:-@\[-`{-~"
SEAMS = re.compile(rf"(?<=[A-Za-z])(?=[0-9{SIGNS}])|(?<=[0-9])(?=[A-Za-z{SIGNS}])|(?<=[!-&(-/:-@\[-`{{-~])(?=[A-Za-z0-9])")

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

_loaded: dict[str, Lengths] = {}


def load(path: str) -> Lengths:
    """The tokenizer and its table of piece lengths, once per worker process."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Lengths(Tokenizer.from_file(path))
    return _loaded[path]


def parts(piece: str) -> list[str]:
    """A piece without blanks as pieces: cut where ASCII letters, digits and signs meet, which this tokenizer keeps apart.

    Not between an apostrophe and a letter, which can be one token, nor inside a run of signs.
    """
    return SEAMS.split(piece) if len(piece) > LONG else [piece]


class Lengths:
    """Tokens of pieces met lately, up to ``limit`` bytes of them; longer pieces than ``LONG`` characters aren't kept."""

    def __init__(self, tokenizer):
        self.tokenizer, self.of, self.size = tokenizer, {}, 0

    def counted(self, batch: list[str]) -> zip:
        return zip(batch, map(len, self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)))

    def learn(self, pieces: set[str], limit: int, batch_bytes: int) -> dict[str, int]:
        """All of ``pieces``, encoded in one call per ``batch_bytes`` where they aren't known."""
        if self.size > limit:
            self.of, self.size = {}, 0
        long, batch, size = {}, [], 0
        for piece in pieces.difference(self.of):
            if len(piece) > LONG:
                long[piece] = sum(n for _, n in self.counted(parts(piece)))
                continue
            batch.append(piece)
            size += len(piece)
            if size >= batch_bytes:
                self.of.update(self.counted(batch))
                self.size, batch, size = self.size + size + 120 * len(batch), [], 0
        if batch:
            self.of.update(self.counted(batch))
            self.size += size + 120 * len(batch)
        return self.of | long if long else self.of


def count_tokens(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, batch_bytes: int = 1 << 20, table_bytes: int = 96 << 20) -> DataFrame:
    """Per row: id, UTF-8 bytes, tokens, and whether the tokens are more than ``limit``.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows and null ids are kept as
    they are; an empty table gives an empty result. Other columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = load(tokenizer_path)
        for part in by_bytes(batches, batch_bytes):
            pieces = [PIECES.findall(text) for text in part.column("text").to_pylist()]
            known = lengths.learn(set().union(*pieces), table_bytes, batch_bytes)
            sizes = [sum(map(known.__getitem__, p)) for p in pieces]
            yield record(SCHEMA, part.column("doc_id"), pc.cast(pc.binary_length(part.column("text")), pa.int64()), sizes, [n > limit for n in sizes])

    return id_text(docs, id_col, text_col).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
