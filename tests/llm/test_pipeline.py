import hashlib
import random

import public_tokenizers
import sentencepiece

import corpus_pipeline as pipeline
from tests.llm import test_decontaminate, test_jaccard, test_lsm_dedup, test_quality


def corpus():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("aeihnorst") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    say = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, item = say(60), say(20)
    docs = [(i, say(rng.randint(60, 160))) for i in range(80)]
    docs += [(100 + i, docs[i][1]) for i in range(5)]
    docs += [(120 + i, " ".join(w if k != 9 else "changed" for k, w in enumerate(docs[i][1].split(" ")))) for i in range(10, 16)]
    docs += [(140 + i, f"{say(70)} {passage}\n{say(20)}") for i in range(6)]
    docs += [(160 + i, f"{say(70)} {item} {say(9)}") for i in range(4)]
    docs += [(180 + i, " ".join(w + "###" for w in say(90).split(" "))) for i in range(12)]
    docs += [(200, None), (201, ""), (202, "few words"), (203, "same word " * 80)]
    return docs, [(1, item), (2, say(25))]


def test_equals_brute_force_stage_by_stage(spark, tmp_path):
    docs, items = corpus()
    frame = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    test_quality.labelled(spark, [(i, int(i < 180), 0) for i, _ in docs if i % 2 == 0]).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left, before = frame, dict(docs)
    for name, stage in pipeline.STAGES[:4]:
        left = stage(spark, left, str(tmp_path)).cache()
        assert left.columns == frame.columns and left.dtypes == frame.dtypes
        now = {r.doc_id: r.text for r in left.collect()}
        if name.startswith("quality"):
            clean = {i for i, t in before.items() if i < 180}
            assert clean <= set(now) and not {i for i in now if 180 <= i <= 203}
        elif "Jaccard" in name:
            classes = test_jaccard.brute(list(before.items()), 5, 80)
            assert set(now) == {i for i in before if classes[i][1] == i}
            assert not {100, 120 + 10} & set(now)
        elif "substring" in name:
            want = test_lsm_dedup.brute(list(before.items()))
            assert now == {i: (before[i] if not w[1] else w[2]) for i, w in want.items() if not w[1] or w[2]}
            assert all(r.n_chars == len(r.text) for r in left.collect())
        else:
            hit = {i for i, t in before.items() for _, item in items if test_decontaminate.distance(item.split(), t.split()) <= 0.2 * len(item.split())}
            assert hit and set(now) == set(before) - hit
        before = now
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for i, t in before.items():
        ids = library.encode(t)
        want[i] = (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    test_quality.labelled(spark, []).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_and_missing_ids(spark, tmp_path):
    """Rows are judged one by one: one of each text stays, and a clean text never goes because its id does."""
    docs, items = corpus()
    a, b, c = (docs[k][1] for k in (20, 30, 40))
    rows = [(1, a), (1, b), (1, a), (2, a), (3, items[0][1] + " and more"), (3, c), (None, b), (None, docs[50][1]), (None, items[0][1])]
    frame = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {}
    for name, stage in pipeline.STAGES[1:4]:
        kept[name] = sorted((r.doc_id or 0, r.text) for r in stage(spark, frame, str(tmp_path)).collect())
    assert kept["n-gram Jaccard join"] == sorted([(1, a), (1, b), (3, c), (0, docs[50][1]), (3, items[0][1] + " and more")])
    assert [i for i, t in kept["substring dedup"] if t == a] == [1] and (0, docs[50][1]) in kept["substring dedup"]
    assert kept["benchmark decontamination"] == sorted((i or 0, t) for i, t in rows if items[0][1] not in t)
