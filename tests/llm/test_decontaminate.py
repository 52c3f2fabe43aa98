import random

import numpy as np

from lodestone.llm import decontaminate as d
from tests.llm.corpus import frame

ITEMS = "item_id long, text string, doc_id long"


def distance(item, words):
    column = list(range(len(item) + 1))
    best = column[-1]
    for w in words:
        before, column[0] = column[:], 0
        for i in range(1, len(item) + 1):
            column[i] = min(before[i - 1] + (item[i - 1] != w), before[i] + 1, column[i - 1] + 1)
        best = min(best, column[-1])
    return best


def case(seed=4):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    say = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    items = [say(rng.randint(10, 40)) for _ in range(12)]
    docs = []
    for i in range(120):
        words = say(rng.randint(0, 120))
        if i % 2:
            passage = list(rng.choice(items))
            for _ in range(rng.randint(0, len(passage) // 4)):
                at = rng.randrange(len(passage))
                rng.choice([lambda: passage.insert(at, "new"), lambda: passage.__setitem__(at, "other"), lambda: passage.pop(at)])()
            cut = rng.randint(0, len(words))
            words[cut:cut] = passage
        docs.append(" ".join(words))
    return items, docs


def test_recall_and_exact_verification(spark):
    items, docs = case()
    bench = spark.createDataFrame([(i, "; ".join(w).upper() + ".", 7) for i, w in enumerate(items)] + [(90, None, 7), (91, "", 7), (92, "of the", 7)], ITEMS)
    got = {(r.doc_id, r.item_id): r.edits for r in d.leaks(frame(spark, [*enumerate(docs), (500, None), (501, "")]), bench, items_at_once=5).collect()}
    want = {}
    for i, text in enumerate(docs):
        for n, item in enumerate(items):
            if (e := distance(item, text.split())) <= int(0.2 * len(item)):
                want[i, n] = e
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got)
    assert len(want) > 30 and len(got) >= 0.97 * len(want)
    assert all(k in got for k, e in want.items() if e == 0)


def hashed(words):
    return d.word_ids([" ".join(words)])[0]


def plan_of(items, **given):
    settings = {"rate": 0.2, "min_words": 5, "bits": 2, "recall": 0.995, "max_tables": 512, "seed": 9} | given
    return d.Plan.of([(i, " ".join(w)) for i, w in enumerate(items)], **settings)


def test_tables_tell_items_apart():
    """The look-up alone, on windows of all kinds: items meet their edited copies and hardly anything else."""
    rng = np.random.default_rng(5)
    items = [[f"w{rng.integers(3000)}" for _ in range(20)] for _ in range(60)]
    (index,) = plan_of(items).lengths
    found = missed = wrong = 0
    for n, item in enumerate(items):
        copies = np.stack([d.edited(hashed(item), 4, rng) for _ in range(40)])
        window, met = index.look_up(copies)
        found += len(set(window[met == n]))
        wrong += (met != n).sum()
    noise = rng.integers(1 << 62, size=(2000, 20)).astype(np.uint64)
    noise[:, rng.integers(20, size=3)] = np.concatenate([hashed(i) for i in items])[:3]
    assert found >= 0.95 * 60 * 40 and wrong <= 0.02 * 60 * 40 * 60
    assert len(index.look_up(noise)[0]) <= 0.02 * 2000 * 60
    assert set(zip(*index.look_up(np.stack([hashed(i) for i in items])))) >= {(n, n) for n in range(60)}


def test_recall_of_every_item():
    """For each item by itself, from fresh edited copies with the most edits allowed."""
    items, _ = case()
    plan, rng = plan_of(items), np.random.default_rng(77)
    for index in plan.lengths:
        for n in index.items:
            copies = np.stack([d.edited(plan.words[n], index.edits, rng) for _ in range(150)])
            window, met = index.look_up(copies)
            assert len(set(window[met == n])) >= 0.95 * 150


def test_items_beyond_the_tables_are_verified_everywhere(spark):
    items, docs = case()
    assert all(index.direct == index.items and not index.tables for index in plan_of(items, max_tables=0).lengths)
    bench = spark.createDataFrame([(i, " ".join(w), 7) for i, w in enumerate(items)], ITEMS)
    got = {(r.doc_id, r.item_id) for r in d.leaks(frame(spark, [*enumerate(docs)]), bench, max_tables=0).collect()}
    assert got == {(i, n) for i, t in enumerate(docs) for n, item in enumerate(items) if distance(item, t.split()) <= int(0.2 * len(item))}


def test_long_texts_and_repeated_ids(spark):
    rng = random.Random(1)
    items, _ = case()
    noise = lambda k: [f"n{rng.randrange(9000)}" for _ in range(k)]
    long = noise(40_000) + items[3] + noise(20_000)
    rows = [(1, " ".join(long)), (2, "x"), (2, " ".join(noise(30) + items[5])), (None, " ".join(items[5]))]
    bench = spark.createDataFrame([(i, " ".join(w), 7) for i, w in enumerate(items)], ITEMS)
    got = sorted((r.doc_id or 0, r.item_id, r.edits, r.start_word) for r in d.leaks(frame(spark, rows), bench).collect())
    assert got == [(0, 5, 0, 0), (1, 3, 0, 40_000), (2, 5, 0, 30)]


def test_walk_keeps_equal_sequences_equal():
    a = np.arange(1, 31, dtype=np.uint64)
    b = a.copy()
    b[20] = 999
    x, y, z = d.walk(np.stack([a, a, b]), 3)
    assert (x == y).all() and 0 < (x != z).sum() < 40


def test_empty_tables(spark):
    empty = spark.createDataFrame([], ITEMS)
    assert d.leaks(frame(spark), empty).count() == 0
    assert d.leaks(frame(spark, []), spark.createDataFrame([(1, "a b c d e f", 1)], ITEMS)).count() == 0


def test_closest_equals_the_table_of_edits():
    rng = np.random.default_rng(3)
    for _ in range(400):
        item, words = (rng.integers(rng.integers(1, 9), size=rng.integers(0, most)).astype(np.uint64) for most in (90, 60))
        edits, end = d.closest(item, words)
        by_end = [len(item), *(min(distance(item.tolist(), words[k:e].tolist()) for k in {0, max(0, e - 2 * len(item))}) for e in range(1, len(words) + 1))]
        assert edits == min(by_end) and end == by_end.index(edits)


def test_walks_that_end_early_give_the_same_keys():
    rng = np.random.default_rng(4)
    windows = rng.integers(1 << 62, size=(30, 12)).astype(np.uint64)
    walks, lasts = np.arange(1, 6, dtype=np.uint64), np.array([18, 11, 11, 4, 0])
    whole = list(d.steps(windows, walks, 19))
    for j, here in enumerate(d.steps(windows, walks, 19, lasts)):
        assert len(here) == (lasts >= j).sum() and (here == whole[j][: len(here)]).all()
