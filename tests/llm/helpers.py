"""Made-up documents for the tests."""

import random

WORDS = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "s", "l", "")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """(doc_id, text, lang, source): copies, near copies, a shared passage, nulls, empty, short and long texts."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(3, 200)) for _ in range(n)]
    passage = prose(rng, 60)
    texts: list[str | None] = list(base)
    texts += [base[0]] * 12 + [base[1], base[1] + " " + prose(rng, 2)]
    texts += [base[i] + " " + passage + " " + prose(rng, 5) for i in range(10, 20)]
    for i in range(20, 30):
        w = base[i].split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [None, "", "   \n\t", "one", "one", "two words", prose(rng, 6000), "x" * 300, "ab" * 200]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, texts[j], "en" if j % 2 else "fr", None if j % 17 == 0 else f"src{j % 3}") for i, j in enumerate(order)]


SCHEMA = "doc_id long, text string, lang string, source string"


def frame(spark, rows=None, schema=SCHEMA):
    return spark.createDataFrame(corpus() if rows is None else rows, schema)


def clashing(df):
    """The same with further columns of clashing names."""
    from pyspark.sql import functions as F

    extra = ("TEXT", "id", "keep_id", "size", "component", "_b", "n", "score")
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(extra)])
