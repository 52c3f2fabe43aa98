import random
import re

from lodestone.llm import jaccard
from tests.llm.corpus import frame, texts


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def chains(seed, n):
    """Families of texts in which each step changes a few words, so that links form chains; some in capitals."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    out = []
    for _ in range(n):
        base = [word() for _ in range(rng.randint(30, 90))]
        for _ in range(rng.randint(1, 14)):
            base = list(base)
            base[rng.randrange(len(base))] = word()
            out.append(" ".join(base).upper() if rng.random() < 0.1 else " ".join(base))
    return out


def test_equals_brute_force(spark):
    for k, percent, short_list, rows in ((4, 85, 32, texts() + chains(1, 30)), (4, 85, 3, chains(2, 40)), (5, 80, 3, chains(3, 25))):
        rows = list(enumerate(rows))
        random.Random(0).shuffle(rows)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(frame(spark, rows), k=k, percent=percent, short_list=short_list, hot_least=4).collect()}
        assert got == brute(rows, k, percent)


def test_empty_table_and_null_id(spark):
    assert jaccard.join(frame(spark, [])).count() == 0
    got = jaccard.join(frame(spark, [(None, "a b c d e"), (5, "a b c d e"), (6, "A b c d e"), (7, "")])).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got if r.doc_id) == [(5, 5), (6, 5), (7, 7)]


def test_repeated_ids_of_different_texts(spark):
    one, two = " ".join(map(str, range(50))), " ".join(map(str, range(50, 90)))
    rows = [(5, one), (5, two), (5, one), (6, two), (7, None), (7, f"{one} more"), (None, one)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(frame(spark, rows)).collect() if r.doc_id is not None)
    assert got == [(5, 37, 5), (5, 47, 5), (5, 47, 5), (6, 37, 5), (7, 0, 7), (7, 48, 5)]


def test_one_long_list_and_a_node_with_many_partners(spark):
    """A line in every text, frequent shingles at the end of the order, and more partners than one task gets."""
    rng = random.Random(8)
    line = " ".join(f"l{k}" for k in range(30))
    rows = [(i, f"{line} {' '.join(f'w{rng.randrange(400)}' for _ in range(i % 6))}") for i in range(400)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(frame(spark, rows), hot_least=4, short_list=8).collect()}
    assert got == brute(rows, 4, 85)
