"""Tables in buckets: versions, what a change writes, and what a lost writer leaves."""

import os

import pytest
from pyspark.sql import functions as F

from harvestry.session import work_folder
from harvestry.sources import buckets as B

SCHEMA = "k int, v string, w double"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def last(spark, folder):
    return rows_of(B.read_version(spark, folder, B.open_version(spark, folder)))


@pytest.fixture()
def table(spark):
    folder = work_folder(spark, "buckets")
    rows = [(i, f"v{i}", float(i)) for i in range(500)] + [(None, "none", None)]
    B.write_buckets(spark.createDataFrame(rows, SCHEMA), folder, -1, ["k"], buckets=16, id_col="k")
    return folder, rows


def test_one_changed_key_writes_one_bucket(spark, table):
    folder, rows = table
    version = B.upsert_version(spark.createDataFrame([(7, "new", 1.5)], "k long, v string, w double"), folder)
    run = f"{folder}/runs/" + version.runs[B.touched_buckets(spark.createDataFrame([(7,)], "k long"), ["k"], 16)[0]]
    written = [n for n in os.listdir(run) if n.startswith("_bucket=")]
    assert len(written) == 1 and len([n for n in os.listdir(f"{run}/{written[0]}") if n.endswith(".parquet")]) == 1
    assert len(set(version.runs.values())) == 2 and len(version.runs) == 16
    assert last(spark, folder) == sorted([r for r in rows if r[0] != 7] + [(7, "new", 1.5)], key=repr)


def test_readers_see_one_version(spark, table):
    folder, rows = table
    before = B.read_version(spark, folder, B.open_version(spark, folder))
    B.upsert_version(spark.createDataFrame([(k, "new", None) for k in range(0, 900, 3)], SCHEMA), folder, {"w": "fill"})
    assert rows_of(before) == sorted(rows, key=repr)
    want = {k: (k, v, w) for k, v, w in rows}
    want |= {k: (k, "new", want.get(k, (0, 0, None))[2]) for k in range(0, 900, 3)}
    assert last(spark, folder) == sorted(want.values(), key=repr)
    assert B.open_version(spark, folder).highest == 897


def test_null_keys_and_replaced_keys(spark, table):
    folder, rows = table
    B.upsert_version(spark.createDataFrame([(None, "other", 2.0)], SCHEMA), folder)
    B.replace_version(spark.createDataFrame([(3, "a", 0.0), (3, "b", 0.0)], SCHEMA), folder)
    want = [r for r in rows if r[0] not in (None, 3)] + [(None, "other", 2.0), (3, "a", 0.0), (3, "b", 0.0)]
    assert last(spark, folder) == sorted(want, key=repr)


def test_run_without_manifest_is_not_seen(spark, table):
    folder, rows = table
    spark.createDataFrame([(1, "lost", 0.0)], SCHEMA).withColumn("_bucket", F.lit(1)).write.partitionBy("_bucket").parquet(f"{folder}/runs/lost")
    assert last(spark, folder) == sorted(rows, key=repr)
    with pytest.raises(RuntimeError):  # a version is never made twice
        B.write_buckets(spark.createDataFrame(rows, SCHEMA), folder, -1, ["k"], buckets=16)


def test_forgotten_versions_and_empty_changes(spark, table):
    folder, rows = table
    empty = spark.createDataFrame([], SCHEMA)
    for _ in range(3):
        version = B.upsert_version(empty, folder)
    B.forget_versions(spark, folder)
    assert B.versions(spark, folder) == [1, 2] and version.highest == 499
    assert len(os.listdir(f"{folder}/runs")) == 1
    assert last(spark, folder) == sorted(rows, key=repr)


def test_empty_table(spark):
    folder = work_folder(spark, "buckets")
    B.write_buckets(spark.createDataFrame([], SCHEMA), folder, -1, ["k"])
    assert last(spark, folder) == []
    B.upsert_version(spark.createDataFrame([(1, "a", None)], SCHEMA), folder)
    assert last(spark, folder) == [(1, "a", None)]


def test_rows_of_buckets_that_were_not_read_are_refused(spark, table):
    folder, _ = table
    with pytest.raises(ValueError):
        B.change_buckets(spark.createDataFrame([(1, "a", None)], SCHEMA), folder, lambda old, new: old.limit(0).union(
            spark.createDataFrame([(k, "x", None) for k in range(500)], SCHEMA)))
