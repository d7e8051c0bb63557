"""Small tables with the awkward cases: nulls, blanks, long texts, ties, repeated rows, clashing columns."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def docs(spark, rows):
    """Rows of (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(*r, *((None, None)[len(r) - 2:] if len(r) < 4 else ())) for r in rows]
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in full], DOCS)


def prose(seed, n, words=400):
    """n words of a vocabulary of ``words`` words."""
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def corpus(seed=1, n=60):
    """Texts with shared passages, near copies, exact copies and odd ones."""
    rng = random.Random(seed)
    shared = [prose(seed + 100 + i, 40) for i in range(3)]
    out = []
    for i in range(n):
        words = prose(seed * 1000 + i, rng.choice([3, 20, 90, 300])).split()
        kind = rng.random()
        if kind < 0.3 and out:
            words = (out[rng.randrange(len(out))] or "a").split()
            for _ in range(rng.randrange(0, 5)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(1000)}"
        elif kind < 0.6:
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(shared).split()
        out.append(" ".join(words))
    return out + [None, "", " \t\n ", "one", "One", "two words", out[0], "é ü x", "tab\tnew\nline " * 20]
