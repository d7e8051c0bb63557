"""Whitening, clustering and window packing against plain loops."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from harvestry.llm import centroids, slack, whitening
from tests.llm.frames import corpus, docs, prose

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])
WORDS = public_tokenizers.path("word_bpe_49k.json")


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1) for i, v in rows], VECTORS)


# whitening


def whitened_by_hand(x, k):
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = (fit * n - s) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return n, ((x * n - s) ** 2).sum(1), (x * n - s) / n @ q / np.sqrt(e), e / np.trace(c.T @ c / n)


def check_whitened(spark, rows, kept, scale=64.0, k=16):
    x = np.floor(scale * np.array([np.float32(v) for _, v in kept], np.float32).astype(float)).astype(int)
    n, deviation, y, explained = whitened_by_hand(x, k)
    got = whitening.whiten(vectors(spark, rows), components=k, scale=scale).collect()
    by = Counter((r.id, r.component) for r in got)
    assert by == Counter((i, c) for i, _ in kept for c in range(1, min(k, x.shape[1]) + 1))
    sign = {}
    for r in got:
        at = next(i for i, (v, _) in enumerate(kept) if v == r.id)
        assert r.n == n and int(r.deviation) == deviation[at] and abs(r.explained / explained[r.component - 1] - 1) < 1e-9
        assert r.identity_error < 1e-10
        want = y[at, r.component - 1]
        sign.setdefault(r.component, 1 if r.whitened * want > 0 or abs(want) < 1e-9 else -1)
        assert abs(r.whitened - sign[r.component] * want) < 1e-8


def test_whitening_against_eigh(spark):
    rng = np.random.default_rng(3)
    mixed = rng.normal(size=(300, 20)) @ rng.normal(size=(20, 20)) / 20
    rows = [(i, v) for i, v in enumerate(mixed)]
    hot = [(1000 + i, mixed[0]) for i in range(150)]  # a third of all rows are one vector: once in the fit list
    odd = [(2000, None), (2001, [None] * 20), (2002, [float("nan")] * 20), (2003, [float("inf")] + [0] * 19), (2004, [1.0]), (2005, []), (2006, [1e20] * 20)]
    check_whitened(spark, rows + hot + odd, rows + hot, k=6)


def test_whitening_of_few_rows(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None)])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1, 2]), (2, [1, 2])])).count() == 0  # no variance
    two = whitening.whiten(vectors(spark, [(1, [1, 2, 0]), (None, [3, 2, 0])])).collect()
    assert sorted((str(r.id), r.component, r.n, int(r.deviation), abs(round(r.whitened, 9)), round(r.explained, 9)) for r in two) == [
        ("1", 1, 2, 128 * 128, 1.0, 1.0), ("None", 1, 2, 128 * 128, 1.0, 1.0)]


def test_whitening_ignores_clashing_columns(spark):
    rows = vectors(spark, [(i, np.random.default_rng(i).normal(size=4)) for i in range(30)]).withColumn("n", F.lit("x")).withColumn("component", F.lit("y"))
    assert whitening.whiten(rows).count() == 30 * 4


def test_deviations_beyond_a_long_are_exact(spark):
    rows = [(i, [float(2**15 * i), float(-(2**15) * i * i)]) for i in range(20)]
    x = [[64 * int(v[0]), 64 * int(v[1])] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    got = {r.id: int(r.deviation) for r in whitening.whiten(vectors(spark, rows)).collect()}
    assert got == {i: sum((20 * a - s) ** 2 for a, s in zip(v, sums)) for (i, _), v in zip(rows, x)}


@pytest.mark.parametrize("dims, wanted", [(1, 16), (5, 16), (40, 7), (300, 16)])
def test_jacobi_davidson(dims, wanted):
    rng = np.random.default_rng(dims)
    q = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
    e = np.sort(np.r_[rng.random(dims - dims // 3), np.full(dims // 3, 0.5)])[::-1]  # a multiple eigenvalue
    v = (q * e) @ q.T
    products = []
    values, axes = whitening.leading_eigenvectors(lambda b: (products.append(b.shape[1]), v @ b)[1], dims, wanted)
    k = min(dims, wanted)
    assert np.allclose(values, e[:k], atol=1e-13) and np.abs(axes.T @ axes - np.eye(k)).max() < 1e-13
    assert np.abs(v @ axes - axes * values).max() < 1e-13
    assert max(products) < max(dims, 24) or dims < 30  # never the whole matrix at once


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(12, 12))
    a, b = a + a.T, rng.normal(size=(12, 3))
    assert np.abs(a @ whitening.minres(lambda x: a @ x, b, 60) - b).max() < 1e-8


# centroids


def clusters_by_hand(rows, k, rounds, dims, scale, seed):
    kept = [(i, [int(np.floor(scale * float(np.float32(c)))) for c in v]) for i, v in rows
            if v is not None and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cents = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        held = {}
        for _, v in kept:
            held.setdefault(near(v)[1], []).append(v)
        cents = [[sum(c) // len(held[j]) for c in zip(*held[j])] if j in held else cents[j] for j in range(len(cents))]
    out = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    each = Counter()
    for _, j, d in out:
        each[j] += d
    return sorted(((str(i), j, d, each[j], sum(each.values()), tuple(cents[j])) for i, j, d in out))


@pytest.mark.parametrize("page", [7, 64, 4096])
def test_clusters_against_a_loop(spark, page):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6) * 0.1) for i in range(120)]
    rows += [(500 + i, rows[3][1]) for i in range(70)] + [(3, rows[4][1]), (3, rows[4][1]), (None, rows[5][1])]
    rows += [(900, None), (901, []), (902, [1.0] * 5), (903, [None] + [1.0] * 5), (904, [float("nan")] * 6), (905, [float("-inf")] * 6)]
    frame = vectors(spark, rows).withColumn("cluster", F.lit("clash"))
    got = centroids.cluster_vectors(frame, clusters=9, rounds=3, dims=6, page_rows=page).collect()
    assert sorted((str(r.id), r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in got) == clusters_by_hand(rows, 9, 3, 6, 256, "2")


def test_clusters_of_few_rows(spark):
    assert centroids.cluster_vectors(vectors(spark, []), dims=3).count() == 0
    assert centroids.cluster_vectors(vectors(spark, [(1, [0.0])]), dims=3).count() == 0
    one = centroids.cluster_vectors(vectors(spark, [(1, [0.5, -0.5]), (2, [0.5, -0.5])]), dims=2).collect()
    assert sorted((r.id, r.cluster, r.distance, r.inertia, r.centroid) for r in one) == [(1, 0, 0, 0, [128, -128]), (2, 0, 0, 0, [128, -128])]


def test_dictionaries_lose_nothing():
    rng = np.random.default_rng(1)
    for x in (rng.integers(-3, 3, (200, 7)), rng.integers(-(2**26), 2**26, (50, 8)), np.tile(rng.integers(0, 99, (1, 64)), (300, 1)), rng.integers(0, 2, (1, 5))):
        blocks = centroids.encode(x)
        assert (np.hstack([found[code] for found, code in blocks]) == x).all()
        assert all(len(np.unique(found, axis=0)) == len(found) for found, _ in blocks)
    assert len(centroids.encode(np.tile(rng.integers(0, 99, (1, 64)), (300, 1)))) == 1  # copies: one wide block


# windows


def check_windows(spark, texts, got, capacity=64, end_id=2):
    tokenizer = Tokenizer.from_file(WORDS)
    want = Counter()
    for i, t in texts:
        want[i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [end_id])] += 1
    ids_of = {}
    for i, ids in want:
        ids_of.setdefault(i, []).append(ids)
    # pieces of each document cover it once; ids_crc32 tells them apart where an id has several texts
    covered = Counter()
    for r in got:
        fits = [ids for ids in ids_of[r.id] if len(ids) == r.doc_tokens and zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32]
        assert fits and r.length > 0
        covered[r.id] += r.length
    assert covered == Counter({i: sum(len(ids) * want[j, ids] for j, ids in want if j == i) for i in ids_of})
    starts = Counter((r.id, r.start, r.doc_tokens) for r in got if r.start == 0)
    assert sum(starts.values()) == len(texts)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    fills = []
    for parts in by.values():
        parts.sort()
        assert all(o == sum(n for _, n in parts[:k]) for k, (o, _) in enumerate(parts))
        fills.append(sum(n for _, n in parts))
    total = sum(covered.values())
    assert Counter(fills) == Counter([capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length()) if total % capacity >> b & 1])


def test_windows_of_a_corpus(spark):
    texts = list(enumerate(corpus(7, 50))) + [(None, "no id here"), (None, None), (3, "another text of one id"), (900, "x " * 5000), (901, "x" * 3000)]
    frame = docs(spark, texts).withColumn("length", F.lit("clash")).repartition(5)
    got = slack.pack_windows(frame, WORDS, capacity=64).collect()
    check_windows(spark, texts, got)


def test_windows_where_every_rest_is_alike(spark):
    texts = [(i, "a b c d e f g h i j") for i in range(40)] + [(5, "a b c d e f g h i j")] * 20  # 11 ids each, a third are one row
    check_windows(spark, texts, slack.pack_windows(docs(spark, texts), WORDS, capacity=64).collect())
    assert slack.pack_windows(docs(spark, []), WORDS).count() == 0
    check_windows(spark, [(1, None)], slack.pack_windows(docs(spark, [(1, None)]), WORDS, capacity=64).collect())


def test_best_filling_against_all_multisets():
    rng = random.Random(6)
    for _ in range(300):
        counts = Counter(rng.choices(range(1, 14), k=rng.randrange(1, 7)))
        window = rng.randrange(1, 30)
        out = slack.best_filling(window, sorted(counts), counts)
        fitting = [x for x in counts if x <= window]
        assert all(out[x] <= counts[x] for x in out) and (max(fitting) in out if fitting else not out)
        if fitting:
            items = list(counts.elements())
            items.remove(max(fitting))
            best = max(sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) + max(fitting) <= window)
            assert sum(x * n for x, n in out.items()) == best + max(fitting)


def test_plan_deals_every_rank_once():
    rng = random.Random(8)
    for counts in ({5: 3, 7: 2}, {3: 1}, {}, {11: 1000}, dict(Counter(rng.choices(range(1, 17), k=300)))):
        rows = slack.Plan(counts, 16).rows.tolist()
        parts = Counter()
        for length, rank, n, start, size, *_ in rows:
            for r in range(rank, rank + n):
                parts.update((length, r, start + i) for i in range(size))
        assert parts == Counter({(length, r, i): 1 for length, n in counts.items() for r in range(n) for i in range(length)})
    # the plan of forty thousand million pieces is as short as that of a few
    assert len(slack.Plan({n: 10**7 for n in range(1, 257)}, 256).rows) < 5000


def test_ids_are_the_tokenizers_own(spark):
    tokenizer, ids_of = Tokenizer.from_file(WORDS), slack.TextIds(WORDS)
    import pyarrow as pa

    assert ids_of.by_word
    odd = ["a.b a.. it. İx ÷× Ÿ ßß! naïve, ÀÉ;", "", " ", "a\x0bb\x0cc\x85d e f", "It's I'LL don't", "é ́x ö", "ΣΑΣ ΟΔΟΣ. İstanbul ẞ", "x<|endoftext|>y <|startoftext|>", "漢字かな交じり文", "\x1c\x1d\x1e\x1f", "\U0001f600️ a‍b", prose(1, 50), "1234 5x6"]
    frame = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for texts in (odd, odd[::-1] + frame, [None, *odd]):
        ids, cuts = ids_of(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_ids_of_a_tokenizer_that_keeps_white_space():
    import pyarrow as pa

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, ids_of = Tokenizer.from_file(path), slack.TextIds(path)
    assert not ids_of.by_word
    ids, cuts = ids_of(pa.array(["one  two", None, "three"]))
    assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in ("one  two", "", "three")]


def same_ids(tokenizer, ids_of, texts):
    import pyarrow as pa

    ids, cuts = ids_of(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


#: Plain words in all cases and with all marks, words that only look like it, and tokens found in the text itself.
LOOK_ALIKES = [
    "House house HOUSE, house. house### house.%%% (house) 'house' house's HOUSE'S house' l'été L'ÉTÉ!", "ÀÖØÞ àöøþ ßÿ ÿ! ß, ŸÿŸ aªb ×÷ a×b",
    "".join(f" Ab{m} aB{m}{m} É{m}" for m in map(chr, range(33, 127))), "J\u030c j\u030c H\u0331 I\u0307 i\u0307 K\u212a \u017fs", "a<|endoftext|> a<|ENDOFTEXT|> A<| a|> <|", "", None,
    "pad PAD padded Pad, one-two ONE_two", "x" * 300 + "!" * 300]


def test_heads_and_tails_are_tokenised_once():
    tokenizer, ids_of, seen = Tokenizer.from_file(WORDS), slack.TextIds(WORDS), Counter()
    encode = ids_of._encode
    ids_of._encode = lambda texts: seen.update(w for t in texts for w in t.split()) or encode(texts)
    assert ids_of.by_part and ids_of.small
    same_ids(tokenizer, ids_of, ["House house, HOUSE. été### ÉTÉ", "house! Été, house###", "house"])
    assert seen == Counter(["house", "été", ",", ".", "!", "###"])
    same_ids(tokenizer, ids_of, LOOK_ALIKES)


def test_words_that_come_up_again_are_kept(monkeypatch):
    tokenizer, ids_of = Tokenizer.from_file(WORDS), slack.TextIds(WORDS)
    monkeypatch.setattr(slack, "KNOWN_WORDS", 16)
    same_ids(tokenizer, ids_of, [" ".join(f"w{'abcdefghij'[i]}x" for i in range(10)) + " again, 1234"])
    same_ids(tokenizer, ids_of, ["again, and once more 1234"])
    same_ids(tokenizer, ids_of, ["again. other wax"])
    assert {"again", ",", "1234"} <= set(ids_of.place) and not {"wbx", "more"} & set(ids_of.place)
    for seed in range(6):
        same_ids(tokenizer, ids_of, [prose(seed, 40), *LOOK_ALIKES])


def test_ids_of_tokenizers_with_other_rules(tmp_path):
    import json

    def changed(name, change):
        rules = json.load(open(WORDS))
        change(rules)
        (tmp_path / name).write_text(json.dumps(rules))
        return str(tmp_path / name)

    def cased(rules):
        rules["normalizer"]["normalizers"].pop()

    def pads(rules):
        rules["added_tokens"].append({"id": 49408, "content": "PAD", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True})

    def together(rules):
        rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\p{L}]+%?|[^\s\p{L}%]+|%"

    for name, change, by_part, small in (("cased", cased, True, False), ("pads", pads, False, True), ("together", together, False, True)):
        path = changed(name, change)
        ids_of = slack.TextIds(path)
        assert (ids_of.by_word, ids_of.by_part, ids_of.small) == (True, by_part, small)
        same_ids(Tokenizer.from_file(path), ids_of, [*LOOK_ALIKES, "Upper UPPER upper% a% PADx xPAD!"])


def test_a_worker_keeps_its_tokenizer_until_the_file_changes(tmp_path):
    import os
    import shutil

    path = str(tmp_path / "rules.json")
    shutil.copyfile(WORDS, path)
    first = slack.text_ids(path)
    assert slack.text_ids(path) is first
    os.utime(path, ns=(1, 1))
    assert slack.text_ids(path) is not first
