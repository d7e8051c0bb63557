"""Tables in hash buckets, with a manifest per version.

``folder/manifests/<version>.json`` names for each bucket the run of files that holds it, ``folder/runs/<run>/_bucket=<n>``
holds the rows.  A write makes one run with the buckets it touches; its manifest takes every other bucket from the
version before, so it costs what it touches, not what the table holds.  The manifest is written aside and renamed when
all files are there: readers take the files of one manifest and see one whole version, and what a lost driver left
behind is named by no manifest.  There is one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harvestry.sources.sinks import replace_keys, upsert

BUCKET = "_bucket"
#: Buckets of a table unless its maker says otherwise; choose it so that a bucket holds some 100 MB.
BUCKETS = 64


class Version(NamedTuple):
    number: int
    keys: list[str]
    buckets: int
    runs: dict[int, str]
    schema: T.StructType
    #: The highest value that the id column ever had, where the table has one.
    highest: int | None
    id_col: str | None


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    """Bucket of a row by its keys as text, so that equal numbers of other types meet; NULL keys have a bucket, too."""
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int")


def touched_buckets(rows: DataFrame, keys: Sequence[str], buckets: int) -> list[int]:
    """The buckets that hold keys of ``rows``; at most ``buckets`` numbers."""
    return sorted(r[0] for r in rows.select(bucket_of(keys, buckets)).distinct().collect())


def _files(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, path = _files(spark, folder)
    return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []


def _manifest(folder: str, number: int) -> str:
    return f"{folder}/manifests/{number + 1:012d}.json"


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the versions that can be read, ascending; -1 is a table before its first change."""
    names = _names(spark, f"{folder}/manifests")
    return sorted(int(n.removesuffix(".json")) - 1 for n in names if n.endswith(".json"))


def open_version(spark: SparkSession, folder: str, number: int | None = None) -> Version:
    """A version, the last one by default."""
    if number is None:
        number = versions(spark, folder)[-1]
    fs, path = _files(spark, _manifest(folder, number))
    stream = fs.open(path)
    try:
        raw = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Version(number, raw["keys"], raw["buckets"], {int(b): r for b, r in raw["runs"].items()},
                   T.StructType.fromJson(raw["schema"]), raw["highest"], raw["id_col"])


def _publish(spark: SparkSession, folder: str, version: Version) -> None:
    raw = version._asdict() | {"schema": version.schema.jsonValue()}
    aside = f"{folder}/manifests/.{uuid.uuid4().hex}"
    fs, path = _files(spark, aside)
    stream = fs.create(path, True)
    try:
        stream.write(json.dumps(raw).encode())
    finally:
        stream.close()
    final = _manifest(folder, version.number)
    if not fs.rename(path, spark._jvm.org.apache.hadoop.fs.Path(final)):
        raise RuntimeError(f"{final} is there already")


def read_version(spark: SparkSession, folder: str, version: Version, buckets: Sequence[int] | None = None) -> DataFrame:
    """The rows of a version, or of some of its buckets; no other file is opened."""
    wanted = version.runs if buckets is None else [b for b in buckets if b in version.runs]
    paths = [f"{folder}/runs/{version.runs[b]}/{BUCKET}={b}" for b in sorted(wanted)]
    return spark.read.schema(version.schema).parquet(*paths) if paths else spark.createDataFrame([], version.schema)


def write_buckets(
    rows: DataFrame, folder: str, number: int, keys: Sequence[str], before: Version | None = None,
    touched: Sequence[int] = (), buckets: int = BUCKETS, id_col: str | None = None,
) -> Version:
    """Version ``number``: ``rows`` are all that the ``touched`` buckets hold from now on, the others stay as in ``before``.

    Without ``before`` a table of ``buckets`` buckets is made.  ``id_col`` names a numeric column whose highest value the
    manifest keeps.  A crowded bucket is written by several tasks in several files, small ones share a task.
    """
    spark = rows.sparkSession
    if before is not None:
        buckets, id_col, schema = before.buckets, before.id_col, before.schema
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in schema])
    else:
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
    run = f"{number + 1:012d}-{uuid.uuid4().hex}"
    spread = rows.withColumn(BUCKET, bucket_of(keys, buckets)).hint("rebalance", F.col(BUCKET))
    spread.write.partitionBy(BUCKET).parquet(f"{folder}/runs/{run}")
    held = {int(n.partition("=")[2]) for n in _names(spark, f"{folder}/runs/{run}") if n.startswith(f"{BUCKET}=")}
    kept = {} if before is None else {b: r for b, r in before.runs.items() if b not in set(touched)}
    if held & set(kept):
        raise ValueError(f"rows of buckets that were not read: {sorted(held & set(kept))[:5]}")
    version = Version(number, list(keys), buckets, kept | {b: run for b in held}, schema, None, id_col)
    if id_col is not None:
        new = read_version(spark, folder, version, sorted(held)).agg(F.max(id_col)).first()[0]
        highest = max([0, *(v for v in (new, before and before.highest) if v is not None)])
        version = version._replace(highest=int(highest))
    _publish(spark, folder, version)
    return version


def forget_versions(spark: SparkSession, folder: str, keep: int = 2) -> None:
    """Delete all but the last ``keep`` versions, and the runs that none of these needs."""
    numbers = versions(spark, folder)
    if len(numbers) <= keep:
        return
    needed = {r for n in numbers[-keep:] for r in open_version(spark, folder, n).runs.values()}
    for number in numbers[:-keep]:
        fs, path = _files(spark, _manifest(folder, number))
        fs.delete(path, False)
    for run in _names(spark, f"{folder}/runs"):
        if run not in needed:
            fs, path = _files(spark, f"{folder}/runs/{run}")
            fs.delete(path, True)


def change_buckets(new: DataFrame, folder: str, change: Callable[[DataFrame, DataFrame], DataFrame]) -> Version:
    """The next version: ``change(old, new)`` over the buckets that hold keys of ``new``."""
    spark = new.sparkSession
    last = open_version(spark, folder)
    touched = touched_buckets(new, last.keys, last.buckets)
    rows = change(read_version(spark, folder, last, touched), new)
    return write_buckets(rows, folder, last.number + 1, last.keys, last, touched)


def upsert_version(new: DataFrame, folder: str, policy: dict[str, str] | None = None) -> Version:
    """``sinks.upsert`` of ``new`` into the table, as its next version."""
    keys = open_version(new.sparkSession, folder).keys
    return change_buckets(new, folder, lambda old, rows: upsert(old, rows, keys, policy))


def replace_version(new: DataFrame, folder: str) -> Version:
    """``sinks.replace_keys`` in the table, as its next version."""
    keys = open_version(new.sparkSession, folder).keys
    return change_buckets(new, folder, lambda old, rows: replace_keys(old, rows, keys))
