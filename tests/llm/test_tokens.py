import random

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from lodestone.llm import piece_codec, token_count
from tests.llm.corpus import frame, texts

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def test_counts_equal_the_library(spark):
    library = Tokenizer.from_file(BPE)
    got = {r.doc_id: r for r in token_count.count_tokens(frame(spark), BPE, batch_bytes=500, table_bytes=20_000).collect()}
    for i, text in enumerate(texts()):
        tokens = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), tokens, tokens > 1024)


def test_long_texts_without_blanks(spark):
    library, rng = Tokenizer.from_file(BPE), random.Random(2)
    pools = ("abcXYZ0189", "ab'st1.,;!-_", "don't12''ll", "aé1²٣'x!", "a1 '", "<|endoftext|>ab1")
    docs = [(i, "".join(rng.choice(pools[i % len(pools)]) for _ in range(rng.randint(250, 9000)))) for i in range(60)]
    got = {r.doc_id: r.n_tokens for r in token_count.count_tokens(frame(spark, docs), BPE).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in docs}
    assert max(map(len, token_count.parts("abc123,.x" * 1000))) <= 4


def test_codec_equals_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: r for r in piece_codec.coded(frame(spark), PIECES, batch_bytes=500, table_limit=200).collect()}
    for i, text in enumerate(texts()):
        ids = library.encode(text or "")
        assert (got[i].n_tokens, got[i].ids, got[i].decoded) == (len(ids), ids, library.decode(ids))


def test_decoder_handles_any_ids():
    codec = piece_codec.PieceCodec(PIECES)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in ("a  b\n\nc", "é́ 한글 \U0001f600", "▁▁a ▁", " \x00x"):
        assert codec.decode(library.encode(text)) == library.decode(library.encode(text))


def test_empty_tables_and_null_ids(spark):
    assert token_count.count_tokens(frame(spark, []), BPE).count() == 0
    assert piece_codec.coded(frame(spark, []), PIECES, digests=True).count() == 0
    assert [r.n_tokens for r in token_count.count_tokens(frame(spark, [(None, "a b"), (None, "a b")]), BPE).collect()] == [2, 2]
