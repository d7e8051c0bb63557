"""Liveness events by timers equal those of the batch operators, also over a restart and out of order."""

import datetime as dt
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from harvestry.session import work_folder
from harvestry.streaming import jobs
from harvestry.streaming.liveness import join_periods, slots_of, stream_liveness_events

SCHEMA = "k long, at timestamp_ntz"
START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def beats():
    """Reporter 0 sends a third of all beats, 7 is online to the end; times are out of order by up to 50 seconds."""
    rng = random.Random(5)
    rows = [(rng.choice([0, 0, 1, 2, 3, 4]), START + dt.timedelta(seconds=20 * i + rng.randint(-25, 25))) for i in range(600)]
    return rows + [(7, START + dt.timedelta(seconds=11_800 + 20 * i)) for i in range(10)] + [(1, None)]


def expected(spark, beats):
    now = max(at for _, at in beats if at) - dt.timedelta(minutes=1)
    periods = jobs.live_sessions(spark.createDataFrame([b for b in beats if b[1]], SCHEMA), "k", "at", timeout=100)
    rows = jobs.period_events(periods, None, "k").filter(F.col("at") < F.lit(now))
    return sorted(map(tuple, rows.collect()))


def test_events_over_batches_and_a_restart(spark, beats, tmp_path):
    folder, given = work_folder(spark, "t"), str(tmp_path / "in")
    schema = None
    for half in range(2):
        for part in range(2):
            at = (2 * half + part) * 153
            spark.createDataFrame(beats[at:at + 153], SCHEMA).coalesce(1).write.mode("append").parquet(given)
        schema = schema or spark.read.parquet(given).schema
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(given)
        stream_liveness_events(source, folder, "k", "at", timeout=100).awaitTermination()
    out = spark.read.parquet(f"{folder}/events").withColumn("at", F.col("at").cast("timestamp_ntz"))
    got = sorted(map(tuple, out.select("k", "event", "at").collect()))
    assert got == expected(spark, beats)
    of_7 = [event for k, event, _ in got if k == 7]
    assert of_7 == ["online"]  # still online


def test_state_rows_follow_the_reporters_not_the_beats(spark, beats, tmp_path):
    folder, given = work_folder(spark, "t"), str(tmp_path / "in")
    rows = [(k, START + dt.timedelta(milliseconds=10 * i)) for i in range(3000) for k in (1, 1, 2)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(given)
    source = spark.readStream.schema(spark.read.parquet(given).schema).parquet(given)
    query = stream_liveness_events(source, folder, "k", "at", timeout=100)
    query.awaitTermination()
    first = query.recentProgress[0]["stateOperators"][0]
    assert first["numRowsUpdated"] < 20 and first["numRowsTotal"] < 20


def test_hot_reporter_is_a_row_per_slot():
    at = pa.array([10**15 + i * 1000 for i in range(200_000)], pa.timestamp("us", "UTC"))
    batch = pa.RecordBatch.from_arrays([pa.array([5] * 200_000), at], ["key", "at"])
    (out,) = list(slots_of(100)([batch]))
    assert out.num_rows <= 3 and pa.compute.max(out.column("hi")).as_py() == 10**15 + 199_999_000


def test_join_periods():
    assert join_periods([], 5) == []
    assert join_periods([(10, 12, False), (0, 5, True)], 5) == [(0, 12, True)]
    assert join_periods([(11, 12, False), (0, 5, False)], 5) == [(0, 5, False), (11, 12, False)]
    assert join_periods([(3, 4, True), (0, 1, False)], 5) == [(3, 4, True)]  # what was told stays


def test_state_rows_follow_the_buckets_not_the_reporters(spark, tmp_path):
    """Also: reporters without a key, large keys and keys that are text have the events of the batch operators."""
    beats = [(None if k == 0 else 2**60 + k, START + dt.timedelta(seconds=s)) for k in range(2000) for s in (k % 90, 400 + k % 70, 3000)]
    for kind in ("long", "string"):
        folder, given = work_folder(spark, "t"), str(tmp_path / kind)
        frame = spark.createDataFrame(beats, SCHEMA).select(F.col("k").cast(kind).alias("k"), "at")
        for low, high in ((0, 100), (100, 2000), (2000, 4000)):
            second = F.unix_micros(F.col("at").cast("timestamp")) / 1e6 - START.replace(tzinfo=dt.timezone.utc).timestamp()
            frame.filter((second >= low) & (second < high)).coalesce(1).write.mode("append").parquet(given)
        source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(given)
        query = stream_liveness_events(source, folder, "k", "at", timeout=100, buckets=16)
        query.awaitTermination()
        states = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
        assert max(s["numRowsTotal"] for s in states) <= 3 * 17
        got = spark.read.parquet(f"{folder}/events").withColumn("at", F.col("at").cast("timestamp_ntz"))
        rows = jobs.period_events(jobs.live_sessions(frame, "k", "at", timeout=100), None, "k")
        want = rows.filter(F.col("at") < F.lit(START + dt.timedelta(seconds=2940))).select(*got.columns)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and got.count() == 8000
