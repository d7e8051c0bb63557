"""Order-dependent operators against plain loops, with keys cut into pieces."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from harvestry.operators import history as H
from harvestry.operators import resources as R
from harvestry.operators.dedupe import first_per_either_key, first_per_key, first_per_observed
from harvestry.operators.problems import apply_problem_events
from harvestry.operators.scans import cut_pieces, with_previous
from harvestry.schemas import PROBLEMS


def hot_events(seed, n=3000, keys=6, hot=0.5):
    """Half of the rows belong to key 0; times come in bursts."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = 0 if rng.random() < hot else rng.randrange(1, keys)
        at = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.choice([rng.randrange(50), rng.randrange(100000)]))
        rows.append((key if rng.random() > 0.02 else None, at, i, rng.random() < 0.5, rng.choice("abc")))
    return rows


SCHEMA = "k long, at timestamp_ntz, id long, ok boolean, v string"


def tied_events(seed, n=600):
    """One key, three moments: only the second ordering column tells rows apart."""
    rng = random.Random(seed)
    return [(0, dt.datetime(2024, 1, 1 + rng.randrange(3)), i, rng.random() < 0.5, rng.choice("abc")) for i in range(n)]


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("per_chunk", [7, 100, 10**6])
def test_previous(spark, per_chunk):
    rows = hot_events(1)
    df = with_previous(spark.createDataFrame(rows, SCHEMA), ["k"], ["at", "id"], ["id", "v"], rows_per_chunk=per_chunk)
    want = {}
    for items in by_key(rows).values():
        for before, now in zip([None, *items], items):
            want[now[2]] = None if before is None else (before[2], before[4])
    got = {r.id: None if r.previous is None else tuple(r.previous) for r in df.collect()}
    assert got == want


@pytest.mark.parametrize("per_chunk", [5, 200, 10**6])
def test_clamped_counters(spark, per_chunk):
    rows = hot_events(2)
    start = [(0, 5, 2, 9, False), (1, 1, 0, 1, True)]
    start_df = spark.createDataFrame(start, "k long, fail_count long, success_count long, total_fail_count long, is_valid boolean")
    exempt = F.col("v") == "c"
    df = R.clamped_counters(
        spark.createDataFrame(rows, SCHEMA), "k", ["at", "id"], F.col("ok"), start_df, exempt=exempt, rows_per_chunk=per_chunk)
    want = {}
    for key, items in by_key(rows).items():
        _, f, s, t, valid = next((x for x in start if x[0] == key), (key, 0, 0, 0, True))
        for _, _, i, ok, v in items:
            if ok:
                s, f, valid = s + 1, max(0, f - 1), True
            else:
                f, t = f + 1, t + 1
                if v == "c":
                    valid = True
                elif f >= 3:
                    valid = False
            want[i] = (s, f, t, valid)
    got = {r.id: (r.success_count, r.fail_count, r.total_fail_count, r.is_valid) for r in df.collect()}
    assert got == want


def massed_events(seed, n=2000):
    """Half of a key's rows at one time, the others spread over a long time."""
    rng = random.Random(seed)
    return [(0, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=0 if i % 2 else rng.randrange(2000)), i, rng.random() < 0.5, rng.choice("abc")) for i in range(n)]


def doubling_events(seed, n=1200):
    """Times that grow as 2^i, in microseconds."""
    rng = random.Random(seed)
    return [(0, dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=2 ** (i * 45 // n) + i), i, rng.random() < 0.5, rng.choice("abc")) for i in range(n)]


@pytest.mark.parametrize("order", [["at", "id"], ["at"]])
@pytest.mark.parametrize("make", [hot_events, tied_events, massed_events, doubling_events])
def test_pieces_are_bounded_and_in_order(spark, make, order):
    """Bursts, rows that all tie, a mass of ties among others, times that double; with one ordering column, too."""
    rows = make(8)
    df = cut_pieces(spark.createDataFrame(rows, SCHEMA), ["k"], order, rows_per_chunk=50)
    pieces, sizes = {}, {}
    for r in df.collect():
        pieces.setdefault(r.k, {}).setdefault(r._chunk, []).append((r.at, r.id) if len(order) == 2 else r.at)
        sizes[r._chunk] = sizes.get(r._chunk, 0) + 1
    assert max(sizes.values()) <= 100
    for parts in pieces.values():
        flat = [x for c in sorted(parts) for x in sorted(parts[c])]
        assert flat == sorted(flat)
    assert len(pieces[0]) > 10


@pytest.mark.parametrize("make", [massed_events, doubling_events])
def test_previous_of_odd_times(spark, make):
    rows = make(4)
    df = with_previous(spark.createDataFrame(rows, SCHEMA), ["k"], ["at", "id"], ["id"], rows_per_chunk=50)
    ids = [r[2] for r in sorted(rows, key=lambda r: (r[1], r[2]))]
    assert {r.id: r.previous and r.previous.id for r in df.collect()} == dict(zip(ids, [None, *ids]))
    alone = with_previous(spark.createDataFrame(rows, SCHEMA), ["k"], ["at"], ["at"], rows_per_chunk=50).collect()
    assert sorted((r.previous.at for r in alone if r.previous)) == sorted(r[1] for r in rows)[:-1]


@pytest.mark.parametrize("per_chunk", [5, 10**6])
@pytest.mark.parametrize("make", [hot_events, tied_events])
def test_reset_counters(spark, per_chunk, make):
    rows = make(3)
    df = R.reset_counters(spark.createDataFrame(rows, SCHEMA), "k", ["at", "id"], F.col("ok"), rows_per_chunk=per_chunk)
    want = {}
    for items in by_key(rows).values():
        s = f = 0
        for _, _, i, ok, _ in items:
            s, f = (s + 1, 0) if ok else (s, f + 1)
            want[i] = (s, f)
    assert {r.id: (r.success_count, r.fail_count) for r in df.collect()} == want


@pytest.mark.parametrize("per_chunk", [9, 10**6])
def test_snapshots_and_changes(spark, per_chunk):
    rows = [r for r in hot_events(4, n=800)]
    df = spark.createDataFrame(rows, SCHEMA)
    args = (["k"], ["at", "id"], ["v", "ok"], [])
    snaps = {r.id for r in H.snapshots(df, *args, rows_per_chunk=per_chunk).collect()}
    changed = {(r.id, r.field_name, r.old_value, r.new_value) for r in H.changes(df, *args, rows_per_chunk=per_chunk).collect()}
    want_snaps, want_changes = set(), set()
    for items in by_key(rows).values():
        stored = None
        for _, _, i, ok, v in items:
            now = {"v": v, "ok": str(ok).lower()}
            if stored is None or stored != now:
                want_snaps.add(i)
                if stored is not None:
                    want_changes |= {(i, f, stored[f], now[f]) for f in now if now[f] != stored[f]}
                stored = now
    assert snaps == want_snaps and changed == want_changes


def test_first_observation_has_no_change(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), 1, True, "a"), (1, dt.datetime(2024, 1, 2), 2, False, "b")], SCHEMA)
    args = (["k"], ["at", "id"], ["v", "ok"], [])
    assert H.snapshots(df, *args).count() == 2
    assert {r.field_name for r in H.changes(df, *args).collect()} == {"v", "ok"}


def test_first_per_key(spark):
    rows = hot_events(5)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.k, r.id) for r in first_per_key(df, ["k"], ["at", "id"]).collect()}
    assert got == {(k, items[0][2]) for k, items in by_key(rows).items() if k is not None}


def test_two_key_greedy(spark):
    rng = random.Random(7)
    rows = [(i, rng.randrange(3), rng.randrange(40), rng.randrange(40)) for i in range(400)]
    # a chain in which every row only becomes free when the one before is dropped
    rows += [(1000 + i, 9, 100 + i // 2, 200 + (i + 1) // 2) for i in range(301)]
    df = spark.createDataFrame(rows, "id long, g long, a long, b long")
    want, seen_a, seen_b = set(), set(), set()
    for i, g, a, b in rows:
        if (g, a) not in seen_a and (g, b) not in seen_b:
            want.add(i)
            seen_a.add((g, a))
            seen_b.add((g, b))
    got = first_per_either_key(df, "a", "b", ["id"], within="g")
    assert {r.id for r in got.collect()} == want


def test_first_per_observed(spark):
    df = spark.createDataFrame([(1, "1.1.1.1"), (2, "1.1.1.1"), (3, "2.2.2.2"), (4, None)], "i long, ip string")
    assert {r.i for r in first_per_observed(df, "ip", ["i"]).collect()} == {1, 3}
    none = df.withColumn("ip", F.lit(None).cast("string"))
    assert {r.i for r in first_per_observed(none, "ip", ["i"]).collect()} == {1, 2, 3, 4}


@pytest.mark.parametrize("per_chunk", [4, 10**6])
def test_problem_events_equal_the_loop(spark, per_chunk):
    rng = random.Random(11)
    now = dt.datetime(2024, 1, 1)
    events = [
        (rng.choice(["report", "report", "resolve"]), rng.randrange(4), rng.choice(["x", "y"]), rng.choice(["error", "warning"]),
         f"m{i}", None, i, i, now + dt.timedelta(minutes=i))
        for i in range(120)
    ]
    table = [(1, 0, "error", "x", "old", None, 1, 0, None, now, now), (2, 0, "error", "x", "gone", None, 1, 1, now, now, now)]
    live = [dict(zip(["id", "j", "t", "c", "m", "e", "a", "r", "ra", "ca", "ua"], row)) for row in table]
    for kind, j, c, t, m, e, a, _, at in events:
        hit = next((p for p in live if p["j"] == j and p["c"] == c and p["r"] == 0), None)
        if kind == "resolve":
            if hit:
                hit.update(r=1, ra=at)
        elif hit:
            hit.update(m=m, a=a, ua=at)
        else:
            live.append({"j": j, "t": t, "c": c, "m": m, "a": a, "r": 0, "ra": None, "ca": at, "ua": at})
    df = spark.createDataFrame(events, "kind string, journal_id long, problem_code string, problem_type string, message string, "
                                       "expected_value long, actual_value long, seq long, at timestamp_ntz")
    got = apply_problem_events(spark.createDataFrame(table, PROBLEMS), df, ["seq"], "at", rows_per_chunk=per_chunk).collect()
    key = ["j", "c", "t", "m", "a", "r", "ra", "ca", "ua"]
    want = sorted((tuple(p[k] for k in key) for p in live), key=repr)
    have = sorted(((r.journal_id, r.problem_code, r.problem_type, r.message, r.actual_value, r.resolved, r.resolved_at,
                    r.created_at, r.updated_at) for r in got), key=repr)
    assert have == want
    assert len({r.id for r in got}) == len(got)


def test_new_ids_are_dense_and_the_same_for_any_partitions(spark):
    from harvestry.operators.ids import with_new_ids

    rows = [(None if i % 3 else i, i % 7, f"t{i}") for i in range(500)] + [(None, 3, "again")] * 200
    table = spark.createDataFrame([(900,), (None,)], "id long")
    want = None
    for parts, limit in ((3, 1_000_000), (211, 20)):
        frame = spark.createDataFrame(rows, "id long, k int, name string").repartition(parts)
        got = with_new_ids(frame, table, F.col("id").isNull(), ["k", "name"], rows_per_chunk=limit).collect()
        assert sorted(r.id for r in got if r.id > 900) == list(range(901, 901 + sum(r[0] is None for r in rows)))
        fresh = [(r.k, r.name) for r in sorted(got, key=lambda r: r.id) if r.id > 900]
        assert fresh == sorted(fresh) and {r.name for r in got if r.id <= 900} == {f"t{i}" for i in range(0, 500, 3)}
        assert want in (None, sorted(got, key=str))
        want = sorted(got, key=str)
    none = with_new_ids(spark.createDataFrame([], "id long, k int"), spark.createDataFrame([], "id long"), F.lit(True), ["k"])
    assert none.count() == 0


def test_rows_without_a_scope_are_a_scope(spark):
    from harvestry.operators.dedupe import first_per_either_key

    rows = [(1, "a", "x", None), (2, "a", "y", None), (3, "a", "z", "s"), (4, "b", "x", None), (5, "b", "w", "s"), (6, "c", "w", "s")]
    frame = spark.createDataFrame(rows, "n int, a string, b string, within string")
    got = first_per_either_key(frame, "a", "b", ["n"], "within").collect()
    assert sorted(r.n for r in got) == [1, 3, 5]


def test_a_count_below_zero_asks_for_no_children(spark):
    from harvestry.operators.children import apply_harvests, replace_if_complete

    old = spark.createDataFrame([(1, "o", 1), (2, "o", 1)], "journal_id long, comment_id string, position_no int")
    expected = spark.createDataFrame([(1, "-1", "0"), (2, "0", "0")], "journal_id long, total_count string, total_pages string")
    none = old.limit(0)
    assert replace_if_complete(old, none, expected).children.count() == 0
    assert {r.journal_id for r in replace_if_complete(old, none, expected, protect_empty=True).children.collect()} == {1, 2}
    harvests = expected.selectExpr("journal_id", "1 harvest", "total_count", "total_pages", "cast(null as string) comment_id", "cast(null as int) position_no")
    assert apply_harvests(old, harvests).children.count() == 0
    assert {r.journal_id for r in apply_harvests(old, harvests, protect_empty=True).children.collect()} == {1, 2}
