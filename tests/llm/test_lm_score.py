from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestone import session
from lodestone.llm import lm_score
from tests.llm.corpus import frame


def corpus(n=400):
    rng = np.random.default_rng(2)
    out = []
    for _ in range(n):
        words = []
        for _ in range(12):
            words += [["the", "a"][rng.integers(2)], f"noun{rng.integers(5)}", ["runs", "sleeps"][rng.integers(2)], "and"]
        out.append(" ".join(words))
    return out


def test_order_counts_on_held_out_texts(spark):
    rng = np.random.default_rng(9)
    held = corpus(420)[400:]
    mixed = [" ".join(rng.permutation(t.split())) for t in held]
    docs = list(enumerate(corpus(400) + held + mixed))
    got = {r.doc_id: r for r in lm_score.score(frame(spark, docs), frequent=20, shared=8, rounds=3).collect()}
    assert all(got[i].n_tokens == 48 and got[i].log_prob < 0 for i, _ in docs)
    assert min(got[400 + i].mean_log_prob for i in range(20)) > max(got[420 + i].mean_log_prob for i in range(20))


def test_order_counts_with_the_registered_defaults(spark):
    rng = np.random.default_rng(9)
    held = corpus(420)[400:]
    mixed = [" ".join(rng.permutation(t.split())) for t in held]
    got = {r.doc_id: r for r in lm_score.score(frame(spark, list(enumerate(corpus(400) + held + mixed)))).collect()}
    assert min(got[400 + i].mean_log_prob for i in range(20)) > max(got[420 + i].mean_log_prob for i in range(20))


def test_every_position_is_a_target(spark):
    """Segments hold each position once as a target, with its neighbours on both sides, in one round."""
    docs = [(1, None), (2, ""), (3, "one"), (4, " ".join(f"w{k % 9}" for k in range(50))), (None, "a b c"), (4, "a b c d")]
    classes = lm_score.Classes(np.unique(np.concatenate([lm_score.hashes([t or ""])[0] for _, t in docs])), 1)
    rows = lm_score.id_text(frame(spark, docs), "doc_id", "text")
    for longest in (3, 7, 8192):
        found = lm_score.segments(rows, classes, 2, 4, longest).toPandas()
        got = []
        for c in found.c:
            held = np.frombuffer(c, "<u2")
            assert 5 <= len(held) <= longest + 4
            got += [tuple(held[k - 2 : k + 3]) for k in range(2, len(held) - 2)]
        want = []
        for _, t in docs:
            own = np.r_[0, 0, classes.of(lm_score.hashes([t or ""])[0]), 0, 0]
            want += [tuple(own[k - 2 : k + 3]) for k in range(2, len(own) - 2)]
        assert sorted(got) == sorted(want) and found.turn.between(0, 3).all()
        pairs = lm_score.pair_counts(spark.createDataFrame(found).select("c"), classes.n, 2)
        naive = np.zeros_like(pairs)
        for _, t in docs:
            own = [0, 0, *classes.of(lm_score.hashes([t or ""])[0]).tolist(), 0, 0]
            for d in (1, 2):
                for x, y in zip(own, own[d:]):
                    naive[d - 1, x, y] += bool(x or y)
        assert (pairs == naive).all()


def test_short_texts_train_with_the_registered_defaults(spark):
    rows = lm_score.id_text(frame(spark, [(1, "alone"), (1, "alone")]), "doc_id", "text")
    classes = lm_score.Classes(lm_score.hashes(["alone"])[0], 1)
    begun = lm_score.WindowNetwork.of_counts(np.array([0, 2, 0]), np.zeros((2, 3, 3), np.int64), 2)
    assert lm_score.train(rows, classes, np.array([0, 2, 0])).bias[1] > begun.bias[1]


def test_partitions_make_no_difference_and_counting_is_beaten(spark):
    """Held-out texts at 1, 16 and 64 partitions: equal scores, above those of a model that only counts words."""
    own, held = corpus(300), corpus(340)[300:]
    docs = frame(spark, list(enumerate(own + held)))
    counts = Counter(w for t in own + held for w in t.split())
    alone = np.mean([np.log(counts[w] / counts.total()) for t in held for w in t.split()])
    means = []
    for n in (1, 16, 64):
        got = {r.doc_id: r.mean_log_prob for r in lm_score.score(docs.repartition(n)).collect()}
        means.append(np.mean([got[len(own) + k] for k in range(len(held))]))
    assert max(means) - min(means) < 0.001 * abs(means[0]) and min(means) > alone + 0.1


def test_scores_equal_brute_force(spark):
    """The sum over positions, worked out one by one from the trained weights and plain counts."""
    docs = [(k, t) for k, t in enumerate(corpus(60) + ["", None, "noun1", "unheard of words and noun2"])]
    rows = lm_score.id_text(frame(spark, docs), "doc_id", "text")
    counts = Counter(w for _, t in docs for w in (t or "").split())
    top = sorted(counts, key=lambda w: (-counts[w], int(lm_score.hashes([w])[0].view(np.int64)[0])))[:5]
    classes = lm_score.Classes(np.concatenate([lm_score.hashes([w])[0] for w in top]), 3)
    of = {w: int(classes.of(lm_score.hashes([w])[0])[0]) for w in counts}
    sizes = np.zeros(classes.n, np.int64)
    for w, n in counts.items():
        sizes[of[w]] += n
    net = lm_score.train(rows, classes, sizes)
    got = {r.doc_id: r for r in lm_score.score(frame(spark, docs), frequent=5, shared=3, near_counts=2).collect()}
    for i, t in docs:
        words, total = (t or "").split(), 0.0
        for k, w in enumerate(words):
            hidden = sum(net.near[d][of[words[j]] if 0 <= j < len(words) else 0].astype(float) for d, j in enumerate((k - 2, k - 1, k + 1, k + 2)))
            logits = net.out.astype(float) @ hidden + net.bias
            total += logits[of[w]] - np.log(np.exp(logits).sum()) + np.log(counts[w] / sizes[of[w]])
        assert got[i].n_tokens == len(words) and np.isclose(got[i].log_prob, total, atol=1e-3)


@pytest.mark.parametrize("near_counts", [0, 4, 1 << 16])
def test_rare_words_are_predicted_not_their_classes(spark, near_counts):
    times = {f"w{k}": k for k in range(1, 13)}
    docs = [(0, "the " * 40), (1, "the w3 the")] + [(100 + k, " ".join([w] * k)) for w, k in times.items()] + [(200 + k, w) for w, k in times.items()] + [(300, None), (300, "w2"), (None, "w2")]
    found = lm_score.score(frame(spark, docs), frequent=1, shared=1, near_counts=near_counts).collect()
    got = {r.doc_id: r for r in found if r.doc_id not in (300, None)}
    assert len(found) == len(docs)
    counts = {w: k + 1 + (w == "w3") + 2 * (w == "w2") for w, k in times.items()}
    p = {w: np.exp(got[200 + k].log_prob) for w, k in times.items()}
    for w in times:
        assert np.isclose(p[w] / sum(p.values()), counts[w] / sum(counts.values()))
    assert sorted(r.n_tokens for r in found if r.doc_id in (300, None)) == [0, 1, 1]
    assert all(np.isclose(np.exp(r.log_prob), p["w2"]) for r in found if r.doc_id in (300, None) and r.n_tokens)
    assert np.isclose(got[201].mean_log_prob, got[201].log_prob) and got[0].n_tokens == 40


def test_gradients_are_worked_out_once_where_shuffle_files_go(spark):
    runs = spark.sparkContext.accumulator(0)

    def part(batches):
        from pyspark import TaskContext

        runs.add(1)
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([2], pa.int64()), pa.array([np.array([1.0, 0.5]).tobytes()], pa.binary())], ["part", "n", "w"])

    with session.tidy(spark):
        n, total = lm_score.summed(spark.range(0, 90, 1, 9).mapInArrow(part, "part int, n long, w binary"), 2)
    assert n == 18 and total.tolist() == [9.0, 4.5] and runs.value == 9


def test_scores_are_conditional_log_probabilities():
    net = lm_score.WindowNetwork(7, 4, 2, 1)
    around = np.array([[0, 1, 2, 3], [4, 5, 6, 0]])
    total = sum(np.exp(net.score(around, np.full(2, c))) for c in range(7))
    assert np.allclose(total, 1, atol=1e-5)
    target, small = np.array([3, 2]), 1e-2
    found = np.concatenate([g.ravel() for g in net.gradient(around, target)])
    flat = net.flat()
    for k in np.random.default_rng(0).choice(len(flat), 40, replace=False):
        moved = [net.load(np.r_[flat[:k], flat[k] + x, flat[k + 1 :]]).score(around, target).sum() for x in (small, -small)]
        assert abs((moved[0] - moved[1]) / (2 * small) - found[k]) < 2e-3


def test_edges(spark):
    got = {r.doc_id: r for r in lm_score.score(frame(spark, [(1, None), (2, ""), (3, " \n"), (4, "one"), (None, "one two")])).collect()}
    assert [(got[i].n_tokens, got[i].mean_log_prob) for i in (1, 2, 3)] == [(0, None)] * 3
    assert got[4].n_tokens == 1 and got[None].log_prob < 0
    assert lm_score.score(frame(spark, [])).count() == 0


def test_bounds_of_counts(spark):
    counts = spark.createDataFrame([(h, n) for h, n in enumerate([100, 90, 50, 50, 9, 8, 3, 1, 1, 1])], "h long, n long")
    for most in range(12):
        for least in (0, 1, 3, 9, 50):
            bound, enough = lm_score.at_least(counts, most, least)
            assert counts.filter(f"n >= {bound}").count() <= most
            assert counts.filter(f"n >= {enough}").count() >= min(least, 10)
    assert lm_score.at_least(counts.limit(0), 5, 5) == (1, 1)
