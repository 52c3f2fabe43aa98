import random

import numpy as np
import pytest

from lodestone.llm import suffix_dedup
from tests.llm.corpus import frame, texts

SIZE = 60


def brute(rows):
    places = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for k, (_, raw) in enumerate(data):
        for s in range(len(raw) - SIZE + 1):
            places.setdefault(raw[s : s + SIZE], []).append((k, s))
    gone = [bytearray(len(raw)) for _, raw in data]
    for found in places.values():
        if len(found) > 1:
            for k, s in found:
                gone[k][s : s + SIZE] = b"\1" * SIZE
    out = {}
    for (i, raw), g in zip(data, gone):
        spans = sum(1 for k in range(len(g)) if g[k] and not (k and g[k - 1]))
        out[i] = (len(raw), sum(g), spans, bytes(b for b, x in zip(raw, g) if not x))
    return out


def test_equals_brute_force(spark):
    rows = list(enumerate(texts()))
    for bucket_bytes in (1 << 23, 2000):  # the second cuts groups at many bucket edges
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.repeated(frame(spark, rows), size=SIZE, width=30, gram=8, bucket_bytes=bucket_bytes).collect()}
        assert got == brute(rows)


@pytest.mark.parametrize("settled", ["class", "again"])
def test_every_string_of_an_edge_group_is_sent(settled):
    """X in one bucket; in the next two variants around one core, neither open, of which the second has X's string."""
    rng = random.Random(3)
    say = lambda k: bytes(rng.choice(b"abcdefgh") for _ in range(k))
    shared, tail = say(SIZE + 6), say(9)
    one, two = say(8), say(8)
    single = settled == "again"
    # An anchor 8 bytes in; X agrees with the second variant before the anchor and with neither after the shared bytes.
    def bucket(*docs):
        rows = {"suffix": [shared + end for _, _, end in docs], "before": [b for _, b, _ in docs]}
        return rows | {"doc_id": np.array([i for i, _, _ in docs]), "lo": np.zeros(len(docs), np.int64), "n": np.full(len(docs), 9), "single": np.full(len(docs), single or len(docs) == 1)}

    def sent(found):
        return {(d, s + k) for _, _, d, s, n, _ in zip(*found) for k in range(n)}

    copies = [1, 2] if settled == "again" else [1]
    variants = [(10 * v + c, b, b"~" + tail) for v, b in ((1, one), (2, two)) for c in copies]
    _, first = suffix_dedup.compare_bucket(bucket((1, two, b" " + tail)), SIZE, 30)
    _, second = suffix_dedup.compare_bucket(bucket(*variants), SIZE, 30)
    text = {i: b + shared + e for i, b, e in [(1, two, b" " + tail), *variants]}
    of = lambda found: {text[d][s : s + SIZE] for d, s in sent(found)}
    assert of(second) == {text[i][s : s + SIZE] for i, _, _ in variants for s in range(9)}
    assert two + shared[: SIZE - 8] in of(first) & of(second)


def test_multikey_quicksort():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 40))) for _ in range(500)] + [b"a" * 30] * 40
    assert [strings[i] for i in suffix_dedup.multikey_quicksort(strings)] == sorted(strings)


def test_empty_table(spark):
    assert suffix_dedup.repeated(frame(spark, [])).count() == 0


def test_repeated_ids_of_different_texts(spark):
    long = " ".join(map(str, range(400)))
    rows = [(1, long), (1, "short"), (2, long), (3, "other"), (3, None), (3, f"{long[:300]} {long}"), (None, long)]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.repeated(frame(spark, rows), size=SIZE, width=30, gram=8).collect() if r.doc_id is not None)
    assert got == sorted((rows[k][0], *v) for k, v in brute([(k, t) for k, (_, t) in enumerate(rows[:-1])]).items())


def test_many_equal_suffixes_are_dealt_out(spark):
    """One passage behind many different beginnings, cut at many bucket edges, and one that copies repeat through a task."""
    rng = random.Random(6)
    say = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    passage, line = say(70), say(80)
    rows = [(i, f"{say(25)}{passage}") for i in range(60)] + [(100 + i, f"{line}{i}") for i in range(40)] + [(200, say(20_000) + passage + say(300))]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.repeated(frame(spark, rows), size=SIZE, width=30, gram=8, bucket_bytes=500).collect()}
    assert got == brute(rows)
