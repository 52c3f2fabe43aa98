import re

import numpy as np

from lodestone.llm import quality
from tests.llm.corpus import frame, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for found in windows.values() if len(found) > 1 for i in found for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_statistics_equal_brute_force(spark):
    rows = list(enumerate(texts())) + [(900, "a\nb\na\n \n \na"), (901, "q r s t q r s")]
    got = {r.doc_id: r for r in quality.judge(frame(spark, rows), labelled(spark, [])).collect()}
    for i, text in rows:
        r, want = got[i], brute(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed)


def test_forest_finds_junk_and_keeps_clean(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("aeinorst"), rng.integers(2, 9)))
    clean = [(i, " ".join(word() for _ in range(120)) + ".") for i in range(300)]
    junk = [(i, " ".join(word() + "###" for _ in range(120))) for i in range(300, 340)] + [(i, " ".join(word().upper() + "!!" for _ in range(120))) for i in range(340, 380)]
    docs = frame(spark, clean + junk)
    got = {r.doc_id: r.kept for r in quality.judge(docs, labelled(spark, [(i, int(i < 300), 0) for i in range(0, 380, 2)])).collect()}
    assert all(got[i] for i in range(300)) and not any(got[i] for i in range(300, 380))
    left = quality.kept(docs, labelled(spark, [(i, int(i < 300), 0) for i in range(0, 380, 2)]))
    assert left.columns == docs.columns and left.count() == 300


def test_empty_table(spark):
    assert quality.judge(frame(spark, []), labelled(spark, [(1, 1, 0)])).count() == 0
