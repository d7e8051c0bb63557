"""Operators on texts against plain loops over small tables."""

import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from harvestry.llm import decontaminate, jaccard, packing, sharding, substrings
from harvestry.llm import words as hashed_words
from harvestry.llm.components import components
from tests.llm.frames import corpus, docs, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(text)]


def shingles(text, n=5):
    w = lowered(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def substrings_by_hand(rows, window):
    starts = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if i is not None:
                starts[key] = min(starts.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for p in range(len(w) - window + 1):
            if i is not None and starts[tuple(w[p : p + window])] < i:
                gone |= set(range(p, p + window))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("group", [50, 3_000_000])
def test_substrings_equal_a_loop(spark, group):
    texts = corpus(3)
    rows = [(100 - i if i % 2 else i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (7, texts[8]), (None, texts[6]), (None, texts[6])]
    frame = docs(spark, rows).withColumn("n_words", F.lit("taken")).withColumn("extra", F.lit(1))
    out = substrings.dedup_substrings(frame, group_suffixes=group)
    assert set(out.columns) == {*frame.columns, "n_removed", "kept_text", "kept_sha256"}
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()), key=repr)
    assert got == substrings_by_hand(rows, substrings.WINDOW)
    assert any(r[2] for r in got)


def test_substrings_of_a_long_text_and_of_nothing(spark):
    long = prose(1, 60_000, 50_000)
    rows = [(1, long), (2, "x " + long[20_000:60_000] + " y"), (3, long)]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup_substrings(docs(spark, rows)).collect())
    assert got == substrings_by_hand(rows, substrings.WINDOW)
    assert substrings.dedup_substrings(docs(spark, [])).count() == 0


def test_windows_that_share_their_first_words_stay_apart(spark):
    # 18 million pairs of windows that differ in the last five words only
    same = prose(2, 8, 10_000)
    rows = [(i, f"{same} {prose(50 + i, 5, 100_000)}") for i in range(6000)] + [(9000, f"{same} {prose(55, 5, 100_000)}")]
    out = substrings.dedup_substrings(docs(spark, rows)).filter("n_removed > 0")
    assert [(r.doc_id, r.n_removed) for r in out.collect()] == [(9000, 13)]


def peak_mb(work):
    """What ``work`` gives, and the MB of Python and numpy objects that it held at once."""
    tracemalloc.start()
    try:
        out = work()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_word_hashes_take_little_memory_and_no_place(monkeypatch):
    text = prose(4, 400_000, 100_000)
    whole, peak = peak_mb(lambda: hashed_words.Words(pa.array([text, None, "z " + text[:100]])))
    assert peak < 25 * len(text) / 1e6  # 39 bytes a byte of text where powers of all places were held
    monkeypatch.setattr(hashed_words, "HASHED_BYTES", 7)
    some = hashed_words.Words(pa.array([text[:3000], None, "z " + text[:100]]))
    assert some.hashes[:400].tolist() == whole.hashes[:400].tolist()
    assert whole.hashes[whole.first[2] + 1 :][:10].tolist() == whole.hashes[:10].tolist()
    assert len(set(whole.hashes.tolist())) == len(set(words(text) + words("z " + text[:100])))


def test_chunks_in_order_are_those_of_the_sorted_batch():
    rng = random.Random(5)
    rows = [(rng.randrange(40), None if i % 9 == 0 else "x" * rng.randrange(50)) for i in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], ["id", "text"])
    got = [part.to_pylist() for part in hashed_words.sorted_chunks(batch, "id", "text", 100)]
    assert got == [part.to_pylist() for part in hashed_words.chunks(batch.sort_by("id"), "text", 100)]
    assert list(hashed_words.sorted_chunks(batch.slice(0, 0), "id", "text", 100)) == []


def test_a_group_of_suffixes_is_sorted_in_stretches():
    rng = np.random.default_rng(6)
    rows, first = [], {}
    for k in range(20):
        ids, counts = rng.permutation(1000)[:100].astype(np.int64), np.full(100, 500, np.int32)
        windows, later = rng.integers(0, 2**64, 50_000, np.uint64), rng.random(50_000) < 0.01
        if rows:
            windows[::50] = np.frombuffer(rows[-1][-1], np.uint64)[: len(windows[::50])]
        for i, w in zip(np.repeat(ids, counts)[~later].tolist(), windows[~later].tolist()):
            first[w] = min(first.get(w, i), i)
        rows.append((7, ids, ids.astype(np.int32), counts, later, windows[~later].tobytes()))
    names, kinds = ["grp", "ids", "hashes", "counts", "later", "windows"], [pa.int32()] + [pa.binary()] * 5
    sent = [(g, i.tobytes(), h.tobytes(), c.tobytes(), np.packbits(x).tobytes(), w) for g, i, h, c, x, w in rows]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*sent), kinds)], names)
    out, peak = peak_mb(lambda: list(substrings._subtrees(1)(iter([batch]))))
    assert peak < 50  # 8 MB of windows; 69 where all were sorted at once
    (out,) = (x.to_pylist()[0] for x in out)
    got, at = {}, 0
    for i, n in zip(np.frombuffer(out["ids"], np.int64).tolist(), np.frombuffer(out["counts"], np.int32).tolist()):
        got.setdefault(i, []).append(np.unpackbits(np.frombuffer(out["bits"], np.uint8, (n + 7) // 8, at), count=n).view(bool).tolist())
        at += (n + 7) // 8
    expected = {}
    for _, ids, _, counts, later, windows in rows:
        marks = later.copy()
        owners = np.repeat(ids, counts)[~later].tolist()
        marks[~later] = [i > first[w] for i, w in zip(owners, np.frombuffer(windows, np.uint64).tolist())]
        for i, bits in zip(ids.tolist(), np.split(marks, np.cumsum(counts)[:-1])):
            if bits.any():
                expected.setdefault(i, []).append(bits.tolist())
    assert got == expected


def groups_by_hand(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if i is None or j is None or not a or not b:
                continue
            if 100 * len(a & b) >= 75 * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return sorted(((i, len(s), find(i) if i is not None else None) for i, s in sets), key=repr)


@pytest.mark.parametrize("listed", [32, 1])
def test_jaccard_groups_equal_a_loop(spark, monkeypatch, listed):
    # with 1 every shared key is crowded and goes through the blocks
    monkeypatch.setattr(jaccard, "LISTED", listed)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    texts = corpus(5, 80)
    chain = prose(9, 200).split()
    for step in range(6):  # neighbours link, the ends don't
        texts.append(" ".join(chain))
        chain[step * 30 : step * 30 + 12] = [f"c{step}{k}" for k in range(12)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4]), (200, texts[4].upper() if texts[4] else None)]
    got = jaccard.jaccard_groups(docs(spark, rows).withColumn("id", F.lit("clash")))
    assert sorted(((r.id, r.n_shingles, r.component_id) for r in got.collect()), key=repr) == groups_by_hand(rows)


def test_jaccard_links_a_document_that_its_batch_kept_back(spark):
    p, q, s, u = prose(1, 30, 9000), prose(2, 30, 9000), prose(3, 50, 9000), prose(4, 50, 9000)
    one = [(0, f"{p} {q}")]
    one += [(10 + i, f"{p} {s} {prose(20 + i, 8, 9000)}") for i in range(9)] + [(30 + i, f"{q} {u} {prose(40 + i, 8, 9000)}") for i in range(9)]
    other = [(99, f"{p.rsplit(' ', 1)[0]} edited {q}")]  # has only P and Q in common with 0, which leads neither in its batch
    frame = docs(spark, one).coalesce(1).union(docs(spark, other))
    assert frame.rdd.glom().map(len).filter(lambda n: n > 1).collect() == [len(one)]  # one batch, and another
    got = sorted((tuple(r) for r in jaccard.jaccard_groups(frame).collect()), key=repr)
    assert got == groups_by_hand(one + other)
    assert (99, len(shingles(other[0][1])), 0) in got


def test_numbers_are_sent_in_the_bytes_they_need():
    for numbers in ([], [5], [-2**63, 2**63 - 1], [0, 255], [0, 256], [7, 70_000, -4], [0, 2**32]):
        assert jaccard._unpacked(jaccard._packed(np.array(numbers, np.int64))).tolist() == numbers
    assert len(jaccard._packed(np.arange(2**40, 2**40 + 200))) == 209  # 1600 bytes as plain longs


def test_jaccard_of_nothing(spark):
    assert jaccard.jaccard_groups(docs(spark, [])).count() == 0
    assert [tuple(r) for r in jaccard.jaccard_groups(docs(spark, [(1, None)])).collect()] == [(1, 0, 1)]


def test_parts_leave_a_spare_one():
    for band in range(1, 30):
        k = jaccard.parts_of(band)
        assert k == 0 or k > 64 * (4 / 3) ** band / 3


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 50)] + [(100, 100 + i) for i in range(1, 200)] + [(7, 7), (None, 3), (60, 61), (61, 60)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(51)}, **{100 + i: 100 for i in range(200)}, 60: 60, 61: 60}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_contamination_equals_a_loop(spark):
    texts = corpus(7)
    items = [" ".join(words(texts[i])[2:30]) for i in (0, 4, 9)] + ["two words", None, "", prose(77, 25), "One", " ".join(words(texts[0])[2:30])]
    base = words(items[0])
    texts += ["x y z " + " ".join(base[:22]) + " tail", " ".join(base[:8]), prose(3, 5000, 4000) + " " + items[6].upper() + " end"]
    rows = list(enumerate(texts)) + [(None, texts[0]), (0, texts[0])]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("source", F.lit("b"))
    want = []
    for i, t in rows:
        for j in range(len(items)):
            s, d = shingles(items[j]), shingles(t)
            if i is not None and s and items.index(items[j]) == j and 4 * len(s & d) >= 3 * len(s):
                want.append((i, j, len(s & d), len(s)))
    for size in (1 << 22, 60):  # one block, and several
        got = decontaminate.contaminated(docs(spark, rows), bench, block_bytes=size)
        assert sorted((r.id, r.item_id, r.n_shared, r.n_item) for r in got.collect()) == sorted(want)
    assert want
    assert decontaminate.contaminated(docs(spark, []), bench).count() == 0
    assert decontaminate.contaminated(docs(spark, rows), bench.limit(0)).count() == 0


def best_fit_by_hand(rows, capacity):
    """Rows of (length, source, cluster), in order: the tightest bin that fits and has neither, the oldest of equals."""
    bins, out = [], []
    for length, source, cluster in rows:
        fits = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= length and b["room"] > 0
                and not (source is not None and source in b["s"]) and not (cluster is not None and cluster in b["c"])]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append({"room": capacity, "s": set(), "c": set()})
        bins[k]["room"] -= length
        bins[k]["s"].add(source)
        bins[k]["c"].add(cluster)
        out.append(k)
    return out


def test_packing_equals_plain_best_fit(spark):
    texts = corpus(11, 150)
    rows = [(i, t, None, None if i % 7 == 0 else f"s{i % 3 and i % 11}") for i, t in enumerate(texts)] + [(0, texts[0], None, None)] * 2 + [(None, texts[3], None, "s1")]
    capacity = 128
    out = packing.pack_documents(docs(spark, rows).withColumn("bin_id", F.lit(9)), capacity=capacity, group_rows=10_000)
    got = sorted(((r.n_words, r.id, r.chunk, r.start_word, r.bin_id) for r in out.collect() if r.n_words), key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))
    text_of = {i: (t, s) for i, t, _, s in rows}
    plain = [(n, text_of[i][1], text_of[i][0]) for n, i, *_ in got]
    assert [b for *_, b in got] == best_fit_by_hand(plain, capacity)
    bins = {}
    for n, i, _, _, b in got:
        held = bins.setdefault(b, {"n": 0, "s": [], "t": []})
        held["n"] += n
        held["s"].append(text_of[i][1])
        held["t"].append(text_of[i][0])
    for held in bins.values():
        sources = [s for s in held["s"] if s is not None]
        assert held["n"] <= capacity and len(sources) == len(set(sources)) and len(held["t"]) == len(set(held["t"]))
    cut = sorted((r.id, r.start_word, r.n_words) for r in out.collect() if r.id == 30)
    assert sum(n for *_, n in cut) == len(words(texts[30]))
    assert {(r.bin_id, r.slot) for r in out.collect() if not r.n_words} == {(None, None)}
    assert out.count() == sum(max(1, -(-len(words(t)) // capacity)) for _, t, _, _ in rows)
    assert packing.pack_documents(docs(spark, [])).count() == 0


def test_best_fit_walks_on_to_a_compatible_bin():
    rng = random.Random(2)
    rows = sorted(((rng.randrange(1, 60), rng.choice([None, 0, 0, 0, 1, 2]), rng.choice([None, None, 0, 1])) for _ in range(300)), key=lambda r: -r[0])
    lengths, sources, clusters = zip(*rows)
    bits = [[0 if v is None else 1 << v for v in column] for column in (sources, clusters)]
    assert packing.best_fit(list(lengths), *bits, 100) == best_fit_by_hand(rows, 100)


def shards_by_hand(rows, shards):
    keyed = []
    for i, t in rows:
        raw = (t or "").encode()
        keyed.append((int(hashlib.md5(raw).hexdigest()[:15], 16), -(2**63) if i is None else i, i, len(raw) + 8, zlib.crc32(raw)))
    keyed.sort(key=lambda r: r[:2])
    total = sum(r[3] for r in keyed)
    held, first = {}, {}
    at = 0
    for r in keyed:
        held[r[0]] = held.get(r[0], 0) + r[3]
        first.setdefault(r[0], at)
        at += r[3]
    out, at, slots = [], 0, {}
    for key, _, i, size, crc in keyed:
        place = at if held[key] * shards * sharding.WHOLE_GROUP > total else first[key]
        shard = min(shards - 1, place * shards // total)
        out.append((i, size, crc, "bytes", shard, slots.get(shard, 0), None))
        slots[shard] = slots.get(shard, 0) + 1
        at += size
    return sorted(out, key=repr)


def test_shards_equal_a_loop(spark):
    texts = corpus(13, 300)
    rows = list(enumerate(texts)) + [(1000 + i, texts[2]) for i in range(400)] + [(None, texts[9]), (None, None), (4, texts[4])]
    frame = docs(spark, rows).withColumn("shard", F.lit("clash"))
    for limit in (2_000_000, 20, 2):
        got = sharding.shard_documents(frame, range_rows=limit)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == shards_by_hand(rows, 24)
    sizes = [r["b"] for r in got.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 24 and max(sizes) - min(sizes) < 0.05 * sum(sizes) / 24 + 2 * max(len(t or "") for t in texts)
    assert sharding.shard_documents(docs(spark, [])).count() == 0


def test_groups_that_lie_in_several_ranges_stay_whole(spark):
    texts = [prose(i, 20 + i % 50) for i in range(600)]
    rows = [(10 * i + k, t) for i, t in enumerate(texts) for k in range(1 + i % 4)]
    got = [sorted((tuple(r) for r in sharding.shard_documents(docs(spark, rows), range_rows=n).collect()), key=repr) for n in (2_000_000, 2)]
    assert got[0] == got[1] == shards_by_hand(rows, 24)


def test_sharding_runs_no_python(spark):
    plan = sharding.shard_documents(docs(spark, [(1, "a"), (2, "b")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_many_copies_of_one_piece_are_spread_over_packing_groups(spark):
    rows = [(7, "same words here", "web")] * 3000 + [(i, f"text number {i}", "web") for i in range(100, 1100)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = packing.pack_documents(frame, group_rows=400).collect()
    assert len(out) == 4000 and sum(r.id == 7 for r in out) == 3000
    assert len({r.bin_id >> 32 for r in out if r.id == 7}) > 4
    assert len({(r.bin_id, r.slot) for r in out}) == 4000
    assert len({r.bin_id for r in out if r.id == 7}) == 3000  # one copy a bin
