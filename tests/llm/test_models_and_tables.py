"""Models by held-out accuracy; vectors, archives and calls against plain loops."""

import gzip
import hashlib
import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from harvestry.llm import langid, neighbours, quality, toolcalls, warc
from harvestry.session import work_folder
from tests.llm.frames import docs

LARGER = "/root/testdata/sf0.01"


def test_language_id_on_the_held_out_fifth(spark):
    frame = spark.read.parquet(f"{LARGER}/documents.parquet")
    out = langid.identify(frame)
    assert out.columns == [*frame.columns, "held_out", "lang_pred", "score"] and out.count() == frame.count()
    long = out.filter("held_out and n_chars > 100").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert long[1] > 100 and long[0] > 0.98
    assert out.filter("score < 0 or score > 1 or score is null").count() == 0


def test_language_id_of_odd_rows(spark):
    de, en = "der die das und ist nicht ein eine ", "the and of that with for this is "
    rows = [(i, (de if i % 2 else en) * 3, "de" if i % 2 else "en", None) for i in range(40)]
    odd = [(100, None, "de", None), (101, "", "en", None), (102, "123 456 !!", "en", None), (None, en * 2, "en", None), (100, de, None, None), (103, de * 20_000, None, None)]
    out = {(r.doc_id, r.text): r for r in langid.identify(docs(spark, rows + odd).withColumn("score", F.lit("clash"))).collect()}
    assert [out[i, t].lang_pred for i, t, *_ in odd] == ["und", "und", "und", "en", "de", "de"]
    assert out[100, None].score == 0 and not out[None, en * 2].held_out
    one = langid.identify(docs(spark, [(1, "x", "en", None)] + rows[:1])).collect()
    assert {r.lang_pred for r in one} == {"en"}
    assert {r.lang_pred for r in langid.identify(docs(spark, [(1, "some text", None, None)])).collect()} == {"und"}
    assert langid.identify(docs(spark, [])).count() == 0


def test_family_comes_first():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(4, 12))
    langs = np.repeat(np.array(["en", "de", "fr", "es"], object), 50)
    x = (np.repeat(centres, 50, 0) + rng.normal(size=(200, 12)) * 0.1).astype(np.float32)
    x = np.hstack([x, np.zeros((200, langid.DIMENSIONS - 12), np.float32)])
    model = langid.fit(langs, x)
    assert model.families == ["germanic", "romance"] and set(model.pairs) == {("de", "en"), ("es", "fr")}
    assert langid.predict(model, x)[0] == langs.tolist()


def test_quality_against_the_labels(spark):
    frame = spark.read.parquet(f"{LARGER}/documents.parquet")
    out = quality.score_quality(frame)
    judged = out.join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id")
    bad, good = (judged.filter(f"quality = {q}").agg(F.avg(F.col("kept").cast("int"))).first()[0] for q in (0, 1))
    assert bad < 0.1 and good > 0.97 and out.count() == frame.count()


def test_quality_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "Some words that make a sentence. And more of them."), (5, "spam " * 500), (5, "spam " * 500), (6, "w " * 200_000)]
    got = quality.score_quality(docs(spark, rows).withColumn("kept", F.lit("clash"))).collect()
    assert len(got) == len(rows) and all(r.score == 0 and not r.kept for r in got if not (r.text or "").strip())
    assert all(0 <= r.score <= 1 for r in got)
    assert quality.score_quality(docs(spark, [])).count() == 0


def test_expectation_maximisation_finds_the_accuracies():
    rng = np.random.default_rng(4)
    truth = rng.random(20_000) < 0.7
    right = rng.random((len(truth), 7)) < np.array([0.95, 0.9, 0.85, 0.8, 0.8, 0.75, 0.9])
    cast = rng.random(right.shape) < 0.7
    votes = np.where(cast, np.where(right == truth[:, None], 2, 1), 0)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.estimate(patterns, counts)
    found = list(model.accuracies().values())
    assert abs(model.prior - 0.7) < 0.05 and np.abs(np.array(found) - [0.95, 0.9, 0.85, 0.8, 0.8, 0.75, 0.9]).max() < 0.05


def links_by_hand(rows, threshold):
    n, root = [0] * len(rows), {i: i for i, *_ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    usable = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v, _ in rows]
    for x, (i, v, a) in enumerate(rows):
        for y, (j, w, b) in enumerate(rows):
            if x == y or not (usable[x] and usable[y]) or a is None or a != b or len(v) != len(w) or i is None or j is None:
                continue
            p, q = np.array(v, float), np.array(w, float)
            if p @ q / np.sqrt((p @ p) * (q @ q)) >= threshold:
                n[x] += 1
                s, t = find(i), find(j)
                root[max(s, t)] = min(s, t)
    return sorted(((i, n[x], find(i) if i is not None else None) for x, (i, *_) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("block, depth_rows", [(1024, 500), (16, 0.01)])
def test_neighbours_against_all_pairs(spark, monkeypatch, block, depth_rows):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "LIST_ROWS", depth_rows)
    rng = np.random.default_rng(5)
    rows = []
    for c in range(60):
        centre = rng.normal(size=24)
        for _ in range(int(rng.integers(1, 9)) if c else 60):
            rows.append((len(rows), [float(np.float32(x)) for x in centre + rng.normal(size=24) * 0.2], c % 3))
    rows += [(900 + k, rows[3][1], rows[3][2]) for k in range(5)]
    rows += [(950, None, 0), (951, [], 0), (952, [0.0] * 24, 0), (953, [float("nan")] * 24, 0), (954, [None] * 24, 0), (955, rows[0][1], None), (None, rows[0][1], 0), (956, [1.0, 2.0], 0), (957, [1.0, 2.1], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("clash"))
    got = sorted(((r.id, r.n_links, r.component_id) for r in neighbours.near_duplicates(frame).collect()), key=repr)
    want = links_by_hand(rows, 0.93)
    found, all_links = sum(r[1] for r in got), sum(r[1] for r in want)
    assert [r[0] for r in got] == [r[0] for r in want] and all(g[1] <= w[1] for g, w in zip(got, want)) and found >= 0.97 * all_links
    assert {g[0]: g[1:] for g in got if g[0] and g[0] >= 950} == {w[0]: w[1:] for w in want if w[0] and w[0] >= 950}
    assert neighbours.near_duplicates(frame.limit(0)).count() == 0


def test_index_recall_on_a_table(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(path).filter("vec_id < 1500").collect()]
    close = [(len(rows) + 10_000 + i, (np.array(v) + np.random.default_rng(i).normal(size=len(v)) * 0.03).tolist(), label) for i, (_, v, label) in enumerate(rows[:500])]
    frame = spark.createDataFrame(rows + close, "vec_id long, embedding array<double>, label int")
    found = neighbours.near_duplicates(frame).agg(F.sum("n_links")).first()[0]
    x, labels = np.array([v for _, v, _ in rows + close]), np.array([c for *_, c in rows + close])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    all_links = int((((x @ x.T) >= 0.93) & (labels[:, None] == labels[None])).sum() - len(x))
    assert all_links > 500 and found >= 0.95 * all_links


def test_archives_round_trip(spark):
    big = "<p>same</p>" * 50
    rows = [(5, "u5", big), (3, "u\r\n3", big), (9, None, big), (1, "u1", "short"), (2, "u2", "short"), (4, "u4", None), (6, "u6", ""), (7, "u7", "WARC/1.1\r\n\r\n\r\n" * 20),
            (8, "u8", "é ü\n\r\n" * 30), (10, "u", "x" * 3_000_000), (None, "n", big), (3, "u3", big), (5, "u5b", "other" * 40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    folder = work_folder(spark, "warc-test")
    warc.write_archives(pages, folder)
    got = warc.read_archives(spark, folder).collect()
    assert all(r.intact for r in got)
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        first = min((j for j, _, h in rows if h == html and j is not None), default=None)
        again = len(raw) >= 100 and i is not None and i != first
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    assert sorted(((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)
    files = [f for f in spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).collect() if f.length > 40]
    assert all(gzip.decompress(f.content).startswith(b"WARC/1.1\r\n") and gzip.decompress(f.content).endswith(b"\r\n\r\n") for f in files)
    empty = work_folder(spark, "warc-test")
    warc.write_archives(pages.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


SCHEMAS = {"f": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer", "minimum": 0}, "l": {"type": "array", "items": {"enum": ["a"]}}}, "additionalProperties": False}}


def linked(spark, messages, calls, results):
    frames = (
        spark.createDataFrame(messages, "conv_id long, turn long, role string, content string"),
        spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, after string"),
        spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string"))
    return toolcalls.link_tool_calls(*(f.withColumn("status", F.lit("clash")) for f in frames), SCHEMAS).collect()


def test_calls_are_linked_ordered_and_checked(spark):
    calls = [
        (1, 2, "b", "f", '{"x": 1, "l": ["a"]}', "a"), (1, 5, "a", "f", '{ "x" : 2 }', None), (1, 3, "c", "f", '{"x": -1}', "zz"), (1, 3, "d", "g", "{}", None),
        (1, 3, "e", "f", "{not json", None), (1, 3, "p", "f", '{"x": 1}', "q"), (1, 3, "q", "f", '{"x": 1}', "p"), (1, 9, "a", "f", '{"x": 3}', None), (1, 4, "u", "f", '{"x": 1}', None),
        (2, 1, "a", "f", '{"y": 1, "x": 0}', None), (None, 1, "n", "f", '{"x": 1}', None), (3, 1, None, "f", '{"x": NaN}', None), (2, 1, "l", "f", '{"x": 1, "l": ["a", "b"]}', None)]
    results = [(1, 6, "a", "A"), (1, 1, "b", "B"), *[(1, 4, k, k) for k in "cdepq"], (1, 7, "a", "again"), (1, 7, "zz", "nobody"), (2, 2, "a", None), (2, 2, "l", ""), (2, 2, "l", "")]
    rows = linked(spark, [(1, 0, "system", "é\n"), (1, 0, None, None)], calls, results)
    at = {(r.conv_id, r.kind, r.call_id, r.turn): r for r in rows}
    state = {k: r.status for k, r in at.items()}
    assert state[1, "call", "a", 5] == "ok" and state[1, "call", "b", 2] == "ok" and state[1, "call", "a", 9] == "duplicate"
    assert [at[1, "call", k, 3].status for k in "cdepq"] == ["invalid", "invalid", "invalid", "circular", "circular"]
    assert state[1, "call", "u", 4] == "unanswered" and state[1, "result", "zz", 7] == "orphan" and state[1, "result", "a", 7] == "duplicate"
    assert state[2, "call", "a", 1] == "invalid" and state[None, "call", "n", 1] == "unanswered" and state[3, "call", None, 1] == "unanswered"
    assert at[1, "call", "c", 3].error == "$.x: out of range" and at[2, "call", "l", 1].error == "$.l[1]: not one of the allowed values"
    # b needs a's result of turn 6
    order = [(r.kind, r.call_id) for r in sorted((r for r in rows if r.conv_id == 1 and r.call_id in ("a", "b") and r.status == "ok"), key=lambda r: (r.order_turn, r.depth, r.step))]
    assert order == [("call", "a"), ("result", "a"), ("call", "b"), ("result", "b")]
    assert at[1, "call", "a", 5].json == '{"role":"assistant","tool_calls":[{"function":{"arguments":"{\\"x\\":2}","name":"f"},"id":"a","type":"function"}]}'
    assert {r.json for r in rows if r.kind == "message"} == {'{"content":"é\\n","role":"system"}', '{"content":null,"role":null}'}
    assert all(json.loads(r.json) for r in rows) and len(rows) == 2 + len(calls) + len(results) - 1


def test_long_chains_take_few_rounds(spark):
    n = 300
    calls = [(1, n - i, f"c{i}", "f", '{"x": 1}', f"c{i - 1}" if i else None) for i in range(n)]
    rows = linked(spark, [], calls, [(1, 5, f"c{i}", "r") for i in range(n)])
    assert [(r.depth, r.order_turn) for r in sorted((r for r in rows if r.kind == "call"), key=lambda r: r.depth)] == [(i, n) for i in range(n)]
    assert linked(spark, [], [], []) == []


def test_language_sample_is_one_text_per_id(spark):
    texts = {"en": "the cat and the dog went to the house", "fr": "le chat et le chien sont dans la maison"}
    rows = [(i, f"{texts[lang]} {i}", lang) for i in range(60) for lang in (("en", "fr")[i % 2],)] + [(2, "the one that repeats", "en")] * 2000
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", 20)
    assert model.families == ["germanic", "romance"]
    _, scores = langid.predict(model, langid.features(pa.array([texts["en"], texts["fr"]])))
    assert langid.predict(model, langid.features(pa.array([texts["en"], texts["fr"]])))[0] == ["en", "fr"] and (scores > 0.5).all()
