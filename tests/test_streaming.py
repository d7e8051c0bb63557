"""Streams over several micro-batches equal the batch operators over everything."""

import datetime as dt
import random
import shutil

import pytest
from pyspark.sql import functions as F

from harvestry.operators import children as C
from harvestry.operators import history as H
from harvestry.operators import resources as R
from harvestry.operators.dedupe import first_per_key
from harvestry.operators.problems import apply_problem_events
from harvestry.schemas import PROBLEMS
from harvestry.session import work_folder
from harvestry.sources.buckets import open_version
from harvestry.streaming import jobs
from harvestry.streaming.batches import finished_versions, read_output, read_state, start_batches

SCHEMA = "k long, at timestamp_ntz, id long, ok boolean, v string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [(rng.choice([0, 0, 1, 2, 3]), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), i, rng.random() < 0.5, rng.choice("ab"))
            for i in range(400)]


@pytest.fixture()
def source(spark, rows, tmp_path):
    """Four files in time order; one is read per micro-batch."""
    folder = str(tmp_path / "in")
    for part in range(4):
        spark.createDataFrame(rows[part * 100:(part + 1) * 100], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(folder)


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    key = repr
    assert sorted(map(tuple, a.select(cols).collect()), key=key) == sorted(map(tuple, b.select(cols).collect()), key=key)


def test_history(spark, source, rows):
    folder = work_folder(spark, "t")
    args = (["k"], ["at", "id"], ["v", "ok"], [])
    query = jobs.stream_history(source, folder, *args)
    query.awaitTermination()
    assert query.lastProgress["batchId"] == 3
    whole = spark.createDataFrame(rows, SCHEMA)
    same(read_output(spark, folder, "snapshots"), H.snapshots(whole, *args))
    same(read_output(spark, folder, "changes"), H.changes(whole, *args))
    assert read_output(spark, folder, "late").count() == 0


def test_counters(spark, source, rows):
    folder = work_folder(spark, "t")
    query = jobs.stream_counters(source, folder, "k", ["at", "id"], F.col("ok"))
    query.awaitTermination()
    whole = R.clamped_counters(spark.createDataFrame(rows, SCHEMA), "k", ["at", "id"], F.col("ok"))
    same(read_output(spark, folder, "counters"), whole)
    last = first_per_key(whole, ["k"], ["at", "id"], last=True)
    same(read_state(spark, folder, query), last.select("k", "success_count", "fail_count", "total_fail_count", "is_valid"))


def events_of(df):
    return df.select(
        F.when(F.col("ok"), "report").otherwise("resolve").alias("kind"), F.col("k").alias("journal_id"), F.col("v").alias("problem_code"),
        F.lit("error").alias("problem_type"), F.col("id").cast("string").alias("message"), F.lit(None).cast("long").alias("expected_value"),
        F.col("id").alias("actual_value"), "at", "id")


def test_problems(spark, source, rows):
    folder = work_folder(spark, "t")
    empty = spark.createDataFrame([], PROBLEMS)
    query = jobs.stream_problems(events_of(source), folder, empty, ["at", "id"], "at")
    query.awaitTermination()
    whole = apply_problem_events(empty, events_of(spark.createDataFrame(rows, SCHEMA)), ["at", "id"], "at")
    state = read_state(spark, folder, query)
    same(state.drop("id"), whole.drop("id"))
    assert state.select("id").distinct().count() == state.count()


def harvests_of(df):
    return df.select(
        F.col("k").alias("journal_id"), F.floor(F.col("id") / 10).alias("harvest"),
        F.when(F.col("ok"), F.col("id").cast("string")).alias("comment_id"), F.col("v").alias("content"),
        F.col("id").alias("position_no"), F.lit(1).alias("total_count"), F.lit(1).alias("total_pages"))


def test_children(spark, source, rows):
    folder = work_folder(spark, "t")
    old = spark.createDataFrame([(0, "o", "x"), (77, "p", "y")], "journal_id long, comment_id string, content string")
    query = jobs.stream_children(harvests_of(source), folder, old)
    query.awaitTermination()
    whole = C.apply_harvests(old, harvests_of(spark.createDataFrame(rows, SCHEMA)))
    same(read_state(spark, folder, query), whole.children)
    same(read_output(spark, folder, "reports"), whole.report)


def test_harvests_equal_one_replacement_after_the_other(spark, rows):
    old = spark.createDataFrame([(0, "o", "x"), (77, "p", "y")], "journal_id long, comment_id string, content string")
    flat = harvests_of(spark.createDataFrame(rows[:60], SCHEMA)).withColumn("total_count", F.col("journal_id") + 1)
    got = C.apply_harvests(old, flat).children
    state = {0: {("o", "x")}, 77: {("p", "y")}}
    for harvest in range(6):
        batch = [r for r in rows[:60] if r[2] // 10 == harvest]
        for key in {r[0] for r in batch}:
            kept = {(str(r[2]), r[4]) for r in batch if r[0] == key and r[3]}
            if len(kept) >= key + 1:
                state[key] = kept
    assert {tuple(r) for r in got.collect()} == {(k, c, v) for k, kids in state.items() for c, v in kids}


def test_liveness(spark, source, rows):
    folder = work_folder(spark, "t")
    jobs.stream_liveness(source, folder, "k", "at", timeout=240).awaitTermination()
    whole = jobs.live_sessions(spark.createDataFrame(rows, SCHEMA), "k", "at", timeout=240)
    closed = whole.filter(F.col("offline_at") < F.lit(rows[-1][1] - dt.timedelta(minutes=1)))
    out = spark.read.parquet(f"{folder}/periods")
    out = out.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c.endswith("_at") or c == "last_heartbeat" else c for c in out.columns])
    same(out, closed)


def test_replayed_batch_changes_nothing(spark, rows):
    args = (["k"], ["at", "id"], ["v"], [])
    df = spark.createDataFrame(rows, SCHEMA)
    first = H.advance_history(None, df.filter("id < 200"), *args)
    again = H.advance_history(first.state, df.filter("id < 200"), *args)
    assert again.snapshots.count() == 0 and again.late.count() == 200
    same(again.state, first.state)


def test_restart_without_new_data_and_old_versions(spark, source, rows):
    folder = work_folder(spark, "t")
    args = (["k"], ["at", "id"], ["v", "ok"], [])
    jobs.stream_history(source, folder, *args).awaitTermination()
    before = read_state(spark, folder).collect()
    again = jobs.stream_history(source, folder, *args)
    again.awaitTermination()
    assert sorted(map(repr, read_state(spark, folder, again).collect())) == sorted(map(repr, before))
    assert finished_versions(spark, folder) == [2, 3]


def test_untouched_buckets_stay_as_they_are(spark, source):
    folder = work_folder(spark, "t")
    old = spark.createDataFrame([(k, "o", "x") for k in range(2000)], "journal_id long, comment_id string, content string")
    jobs.stream_children(harvests_of(source), folder, old).awaitTermination()
    runs = list(open_version(spark, f"{folder}/state").runs.values())
    first = min(runs)
    assert len(runs) == 64 and runs.count(first) >= 60  # four keys have events


def test_finished_batch_is_not_done_again(spark, source, rows):
    folder = work_folder(spark, "t")
    calls = []

    def step(state, batch):
        calls.append(1)
        return batch.select("k", "id"), {}

    start_batches(source, folder, step, ["k"]).awaitTermination()
    assert len(calls) == 4
    shutil.rmtree(f"{folder}/checkpoint/commits")  # as if the driver was lost after the state, before the commit
    start_batches(source, folder, step, ["k"]).awaitTermination()
    assert len(calls) == 4


def test_event_parts_are_micro_batches_of_several_files(spark, sf_dir, monkeypatch):
    """Each part of the events is a micro-batch of whole days in order, in files that tasks share."""
    from harvestry.catalog import streams

    monkeypatch.setattr(streams, "ROWS_PER_FILE", 60)
    seen = []

    def look(batch, batch_id):
        day = F.col("ts").cast("date")
        seen.append(batch.agg(F.count("*"), F.min(day), F.max(day), F.count_distinct("file")).first())

    source = streams.event_stream(spark, sf_dir).select("*", F.input_file_name().alias("file"))
    source.writeStream.foreachBatch(look).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 4 and sum(s[0] for s in seen) == spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert all(a[2] < b[1] for a, b in zip(seen, seen[1:]))
    assert len({s[3] for s in seen}) == 1 and seen[0][3] > 1
