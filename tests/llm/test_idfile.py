import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from lodestone.llm import idcoder, idfile
from tests.llm.corpus import frame, texts

WORDS = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=15, deadline=None)
@given(st.one_of(st.lists(st.integers(0, 65535), max_size=300), st.lists(st.integers(0, 2**32 - 1), max_size=300)), st.sampled_from([16, 64]))
def test_round_trip(ids, block):
    assert idcoder.decode(idcoder.encode(np.array(ids, np.int64), block)).tolist() == ids


def test_repeats_cost_little_and_damage_is_found():
    ids = np.tile(np.arange(100, 400), 20)
    stream = idcoder.encode(ids, block=2048)
    assert len(stream) < len(ids)
    broken = bytearray(stream)
    broken[-40] ^= 1
    with pytest.raises(ValueError):
        idcoder.decode(bytes(broken))


def test_skewed_and_long_streams():
    """Carries, certain successors, an id alone, more blocks than lanes, and less room than a static table of frequencies would take."""
    rng = np.random.default_rng(3)
    frequent = np.minimum(rng.zipf(1.3, 60_000), 49_000)
    chains = np.where(rng.random(60_000) < 0.5, np.roll(frequent, 1) * 7919 % 5000, frequent)
    for ids in (frequent, chains, np.zeros(5000, np.int64), np.arange(3000), np.r_[np.full(9000, 7), 2**31]):
        stream = idcoder.encode(ids, block=256, lanes=64)
        assert (idcoder.decode(stream, lanes=50) == ids).all()
    p = np.unique(frequent, return_counts=True)[1] / len(frequent)
    static = -(p * np.log2(p)).sum() * len(frequent) / 8
    assert len(idcoder.encode(frequent)) < 1.15 * static


def test_pieces_equal_the_library():
    table, library = idfile.IdTable(WORDS), Tokenizer.from_file(WORDS)
    rng = random.Random(5)
    odd = ["".join(rng.choice(" \n\tabE'.,1é́×ſΣß<|>s\xa0\x1c") for _ in range(rng.randint(0, 40))) for _ in range(800)]
    odd += ["don't., a<|endoftext|>.b x<|startoftext|>", "ΑΣ. ΣΑΣ, a×. ×,"] + [t or "" for t in texts()]
    for text, got in zip(odd, [x for k in range(0, len(odd), 100) for x in table.encode(odd[k : k + 100], 1000)]):
        assert np.frombuffer(got, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


def test_latin_texts_are_cut_as_arrays_and_equal_the_library():
    """Neighbours of every class, capitals, odd blanks, signs and digits; a small table that is emptied again and again; long pieces among short ones."""
    library, rng = Tokenizer.from_file(WORDS), random.Random(11)
    kinds = [chr(c) for c in range(256)], "'stremvldSTREMVLD .1-", "aÀÉéßÞþÿ×÷ªµº.'0 \n", "ab\x85\xa0\t\x1c\u0301.É́ "
    odd = ["".join(rng.choice(kind) for _ in range(rng.randint(0, 40))) for kind in kinds for _ in range(500)] + ["x" * 3000 + "'s " + "É" * 100, "é" * 70, "", " \n "]
    rng.shuffle(odd)
    for limit in (1000, 1 << 20):
        table = idfile.IdTable(WORDS)
        for k in range(0, len(odd), 150):
            counts, ids = table.coded(odd[k : k + 150], limit)
            want = [library.encode(t, add_special_tokens=False).ids for t in odd[k : k + 150]]
            assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
    # Letters apart from signs and digits, whatever their case, are few pieces to ask the library for.
    pieces, counts = idfile.cut([b"The end(the END).The 12\xc9t\xe9", b"", b"don't"])
    assert pieces.to_pylist() == [b"the", b"end", b"(", b"the", b"end", b").", b"the", b"1", b"2", b"\xe9t\xe9", b"don", b"'t"] and counts.tolist() == [10, 0, 2]
    with pytest.raises(ValueError):
        idfile.IdTable(public_tokenizers.path("byte_bpe_50k.json"))


def test_coder_is_exact_where_parts_are_narrow():
    """More distinct ids than one refill of the range allows, and parts so narrow that quotients of floats can miss their edges."""
    rng = np.random.default_rng(8)
    many = np.arange(1 << 18) * 5
    skewed = np.r_[np.zeros(200_000, np.int64), rng.integers(0, 1 << 17, 60_000)]
    rng.shuffle(skewed)
    for ids in (many, skewed, rng.integers(0, 1 << 32, 20_000)):
        assert (idcoder.decode(idcoder.encode(ids, block=512)) == ids).all()
    assert idcoder.Table.of(many)[0].bits > idcoder.FREQ


def test_files_hold_every_document(spark, tmp_path):
    library = Tokenizer.from_file(WORDS)
    rows = list(enumerate(texts()))
    random.Random(1).shuffle(rows)
    path = str(tmp_path / "ids")
    idfile.write(frame(spark, rows).repartition(3), WORDS, path, segment_ids=3000, block=64)
    got = {r.doc_id: r for r in idfile.read(spark, path, digests=True).collect()}
    whole = {r.doc_id: (r.start, r.n_tokens, zlib.crc32(r.ids)) for r in idfile.read(spark, path).collect()}
    assert whole == {i: (r.start, r.n_tokens, r.ids_crc32) for i, r in got.items()}
    start = 0
    for i, text in sorted(rows):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    idfile.write(frame(spark, []), WORDS, path)
    assert idfile.read(spark, path).count() == 0


def test_repeated_and_missing_ids(spark, tmp_path):
    path = str(tmp_path / "repeats")
    rows = [(4, "a b"), (4, "c"), (None, "d e f"), (2, None), (4, "a b")]
    idfile.write(frame(spark, rows), WORDS, path)
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in idfile.read(spark, path).collect())
    assert [r[1] for r in got] == [None, 2, 4, 4, 4] and sorted(r[2] for r in got) == [1, 2, 3, 3, 4]
    assert [r[0] for r in got] == [sum(r[2] for r in got[:k]) for k in range(5)]
