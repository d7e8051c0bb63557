"""Terms against names: the prefix filter loses no pair and pairs nothing up."""

import random

import pytest

from harvestry.operators.fuzzy import fuzzy_pairs


def grams(text):
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return {("  " + w + " ")[i:i + 3] for w in words for i in range(len(w) + 1)}


@pytest.mark.parametrize("threshold", [0.1, 0.3, 0.5, 0.8, 1.0])
def test_equals_all_pairs(spark, threshold):
    rng = random.Random(9)
    words = ["nature", "natura", "physics", "physical", "review", "reviews", "cell", "the", "of", "Zeitschrift", "für", "数学", "2d"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))
    names = [text() for _ in range(150)] * 2 + [None, "", " - ", "NATURE"]
    terms = [text() for _ in range(60)] + ["natur", "nature", None, "?!"]
    got = fuzzy_pairs(spark.createDataFrame([(n, 1) for n in names], "name string, term int"),
                      spark.createDataFrame([(t,) for t in terms], "term string"), threshold=threshold).collect()
    want = {}
    for t in {t for t in terms if t}:
        for n in {n for n in names if n}:
            a, b = grams(t), grams(n)
            if a and b and len(a & b) / len(a | b) >= threshold:
                want[t, n] = len(a & b) / len(a | b)
    assert len(got) == len(want) > 0
    assert {(r["term"], r["name"]): r["similarity"] for r in got} == pytest.approx(want)


def test_no_cross_join_and_empty_tables(spark):
    empty = spark.createDataFrame([], "name string")
    terms = spark.createDataFrame([("a b",)], "term string")
    found = fuzzy_pairs(empty, terms)
    assert found.count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
