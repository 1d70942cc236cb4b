"""Small tables with every odd case: nulls, empty and long texts, repeated rows, ties, clashing extra columns."""

import random

DOCS = "doc_id long, text string, source string, lang string, score double, node long, key string, region string"


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source); the other columns clash with the operators' own names."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "s", None, 1.0, 7, "k", "r") for r in rows]
    return spark.createDataFrame(full, DOCS)


def words(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed: int, n: int = 60):
    """Random texts with exact and near copies, blank, null, short and long ones."""
    rng = random.Random(seed)
    base = [words(rng, rng.choice((3, 12, 40, 120))) for _ in range(n // 4)]
    out = []
    for i in range(n):
        t = rng.choice(base).split(" ")
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
            t[rng.randrange(len(t))] = f"x{rng.randrange(50)}"
        out.append((i, " ".join(t)))
    out += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "one two"), (n + 6, words(rng, 30_000, 10_000))]
    return [*out, out[3], out[3], (None, out[0][1])]
