"""The registered queries against their SQL, and the pipeline stage by stage."""

import pytest

import corpus_pipeline
from harvestry.llm.queries import ORACLE, QUERIES
from tests.llm.test_text_operators import groups_by_hand, substrings_by_hand, shingles, words
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf_dir, name):
    diff, rows, _ = compare(spark, con, sf_dir, name, QUERIES[name], ORACLE.get(name))
    assert diff is None and rows, diff


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "substring_dedup", "decontamination", "best_fit_packing"]
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).cache()
        before, after = ([tuple(r) for r in f.collect()] for f in (docs, out))
        if name != "best_fit_packing":
            assert out.columns == corpus_pipeline.COLUMNS
        texts = {r[0]: r[1] for r in before}
        if name == "language_id":
            assert sorted(after) == sorted(r for r in before if r[1] and any(c.isalpha() for c in r[1]))
        elif name == "near_duplicates":
            keep = {i for i, _, c in groups_by_hand([(i, texts[i]) for i in sorted(texts)]) if i == c}
            assert sorted(after) == sorted(r for r in before if r[0] in keep)
        elif name == "substring_dedup":
            removed = {i: n for i, _, n, _ in substrings_by_hand(sorted(texts.items()), 13)}
            assert {r[0]: len(words(r[1])) for r in after} == {i: len(words(t)) - removed[i] for i, t in texts.items() if len(words(t)) > removed[i]}
        elif name == "decontamination":
            sets = [shingles(t) for t in items]
            clean = [r for r in before if not any(s and 4 * len(s & shingles(r[1])) >= 3 * len(s) for s in sets)]
            assert sorted(after) == sorted(clean)
        else:
            assert {r[0] for r in after} == set(texts) and sum(r[3] for r in after) == sum(len(words(t)) for t in texts.values())
        docs = out


def test_pipeline_takes_odd_rows(spark, sf_dir):
    from tests.llm.frames import docs

    rows = [(1, None), (2, ""), (3, "the and of " * 30, "en", "a"), (3, "the and of " * 30, "en", "a"), (None, "some words here", "en", None), (4, "12 34")]
    frame = docs(spark, rows)
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, sf_dir)
    assert sorted({r.doc_id for r in frame.collect()}, key=str) == [3, None]
    frame = docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, sf_dir)
    assert frame.count() == 0


def test_near_duplicates_keep_different_texts_of_one_id(spark):
    import random

    from corpus_pipeline import COLUMNS, near_duplicates

    rng = random.Random(5)
    a, b, c = (" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=60)) for _ in range(3))
    rows = [(1, a), (2, b), (2, a), (2, b), (3, c), (4, c + " z"), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = near_duplicates(spark, docs, "")
    assert out.columns == COLUMNS
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    kept_a = [g for g in got if g[1] == a and g[0] is not None]
    assert len(kept_a) == 1 and kept_a[0][0] in (1, 2)
    assert sorted((g for g in got if g[1] != a), key=repr) == sorted([(2, b), (3, c)], key=repr) and (None, a) in got
