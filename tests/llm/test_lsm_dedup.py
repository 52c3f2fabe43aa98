import hashlib
import random

import numpy as np

from lodestone.llm import lsm_dedup, staging
from tests.llm.corpus import frame, texts

SIZE = 20


def brute(rows):
    seen, out = {}, {}
    for doc_id, text in sorted(rows):
        words = [w.decode() for w in (text or "").encode().split()]
        gone = [False] * len(words)
        for i in range(len(words) - SIZE + 1):
            if seen.setdefault(tuple(words[i : i + SIZE]), (doc_id, i)) != (doc_id, i):
                gone[i : i + SIZE] = [True] * SIZE
        out[doc_id] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g))
    return out


def test_equals_brute_force(spark):
    rows = list(enumerate(texts()))
    for batches, fan_in in ((1, 2), (2, 2), (3, 4)):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in lsm_dedup.repeated(frame(spark, rows), batches=batches, fan_in=fan_in).collect()}
        assert got == brute(rows)


def test_empty_table_and_null_id(spark):
    assert lsm_dedup.repeated(frame(spark, [])).count() == 0
    long = " ".join(map(str, range(40)))
    got = lsm_dedup.repeated(frame(spark, [(None, long), (3, long), (4, long)])).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in got) == [(False, 0), (False, 40), (True, 0)]


def keyed(rows):
    """Rows that repeat an id, in the order that the operators give them, under numbers of their own."""
    order = sorted(rows, key=lambda r: (r[0], hashlib.md5((r[1] or "").encode()).hexdigest()))
    return list(enumerate(t for _, t in order)), [i for i, _ in order]


def test_repeated_ids_of_different_texts(spark):
    long = " ".join(map(str, range(400)))
    rows = [(0, long), (1, long), (1, "short"), (3, long[:900]), (3, None), (3, f"{long} {long}"), (None, long)]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in lsm_dedup.repeated(frame(spark, rows)).collect() if r.doc_id is not None)
    numbered, ids = keyed(rows[:-1])
    assert got == sorted((ids[k], *v) for k, v in brute(numbered).items())


def test_very_long_text(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[30_000:30_200])), (3, " ".join(words[::-1]))]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in lsm_dedup.repeated(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_index_opened_again_over_three_sessions(spark, tmp_path):
    """Batches of three sessions, the last with ids that an earlier one has: as brute force over all of them in turn."""
    rows, folder = list(enumerate(texts())), str(tmp_path / "index")
    cuts = [rows[:40], rows[40:75], [(i - 70, t) for i, t in rows[75:]]]
    numbered = [(1000 * k + j, t) for k, part in enumerate(cuts) for j, (_, t) in enumerate(part)]
    want, got = brute(numbered), {}
    lsm_dedup.FingerprintIndex(spark, 4, folder=folder)._save()
    for k, part in enumerate(cuts):
        index = lsm_dedup.FingerprintIndex.open(spark.newSession(), folder)
        place = {i: 1000 * k + j for j, (i, _) in enumerate(part)}
        got |= {place[r.doc_id]: (r.n_words, r.n_removed, r.kept) for r in index.dedupe(frame(spark, part)).collect()}
    assert got == want


def test_seen_keeps_to_earlier_documents():
    seen, key = staging.Seen(2), np.arange(1, 40)
    seen.add(key, key, np.full(39, 5))
    kept = seen.times(key, key, np.full(39, 6)) > 0
    assert 0 < kept.sum() <= 4
    assert not seen.times(key, key, np.full(39, 5)).any() and not seen.times(key, key + 1, np.full(39, 6)).any()
    seen.add(key[kept], key[kept], np.full(kept.sum(), 6))
    assert (seen.times(key[kept], key[kept], np.full(kept.sum(), 9)) == 2).all()
