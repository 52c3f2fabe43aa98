"""A small corpus with the awkward cases: nulls, empty and long texts, copies, repeats, odd characters."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, lo int, h1 long"


def texts(seed=7, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeihnorst") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    say = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, line = say(70), say(9)
    out = [None, "", "   \n\t", "one two three", "a b 　 c\x1c d <|endoftext|> é ﬁ 😀 ▁x"]
    for i in range(n):
        body = say(rng.randint(5, 150))
        if i % 4 == 0:
            body = f"{line}\n{body}"
        if i % 5 == 0:
            body = f"{body}\n{passage} {say(rng.randint(0, 30))}"
        if i % 7 == 0:
            words = passage.split(" ")
            body = f"{' '.join(words[rng.randint(0, 9): 70 - rng.randint(0, 9)])} {body}  {passage}"
        out.append(body)
    for i in range(n // 3):
        words = (out[5 + i] or "").split(" ")
        if i % 2 and len(words) > 3:
            words[rng.randrange(len(words))] = "changed"
        out.append(" ".join(words))
    out.append("ab " * 700)
    out.append("x" * 3000)
    out += [out[8]] * 15
    return out


def frame(spark, rows=None):
    """As ``documents``, with extra columns under names that operators use inside."""
    rows = list(enumerate(texts())) if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t), 1, 2) for i, t in rows], DOCS)
