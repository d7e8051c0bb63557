"""Online and offline events of reporters on a stream, by event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, IntegralType, LongType, StringType, StructField, StructType

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Kinds of rows in the state: a period whose start isn't told yet, one whose start is, and the end of the last one that is over.
_OPEN, _TOLD, _CLOSED = 0, 1, 2
#: Buckets of the reporters; choose it so that a bucket's open reporters are some ten thousand at most.
BUCKETS = 256


def slots_of(timeout: int):
    """Beats (key, time) of each Arrow batch as one row per key and slot of ``timeout`` seconds.

    Beats of one slot always belong together.  A reporter with a third of all beats thus sends a row per slot and
    batch to its task, however often it reports.
    """

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, at = batch.column(0), batch.column(1)
            us = pc.cast(at, pa.int64())
            table = pa.table({"key": key, "at": at, "us": us, "slot": pc.floor(pc.divide(us.cast(pa.float64()), timeout * 1e6))})
            slots = table.group_by(["key", "slot"]).aggregate([("at", "max"), ("us", "min"), ("us", "max")])
            for part in slots.select(["key", "at_max", "us_min", "us_max"]).to_batches():
                yield pa.RecordBatch.from_arrays(part.columns, ["key", "seen", "lo", "hi"])

    return reduce


def _joined(periods: pd.DataFrame, timeout_us: int) -> pd.DataFrame:
    """(key, first, last, kind) intervals with those of a key at most a timeout apart joined; a told start stays the start."""
    if len(periods) < 2:
        return periods
    code = pd.factorize(periods["key"], use_na_sentinel=False)[0]
    order = np.lexsort((periods["kind"], periods["last"], periods["first"], code))
    key, code = periods["key"].iloc[order], code[order]
    first, last, kind = (periods[c].to_numpy()[order] for c in ("first", "last", "kind"))
    reach = pd.Series(last).groupby(code).cummax().to_numpy()
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (first[1:] > reach[:-1] + timeout_us)
    at = np.flatnonzero(new)
    start, told = first[at], np.flatnonzero(kind == _TOLD)
    group, place = np.unique(np.cumsum(new)[told] - 1, return_index=True)
    start[group] = first[told[place]]
    return pd.DataFrame({"key": key.iloc[at].to_numpy(), "first": start, "last": np.maximum.reduceat(last, at), "kind": np.maximum.reduceat(kind, at)})


def join_periods(periods: list[tuple[int, int, bool]], timeout_us: int) -> list[tuple[int, int, bool]]:
    """(first beat, last beat, told) intervals of one reporter, joined and in order."""
    rows = [(0, first, last, int(told)) for first, last, told in periods]
    joined = _joined(pd.DataFrame(rows, columns=["key", "first", "last", "kind"]), timeout_us)
    return [(first, last, kind == _TOLD) for _, first, last, kind in joined.itertuples(index=False)]


def _due(us):
    """The timer of instants: whole milliseconds, rounded up."""
    return -(-us // 1000)


class _Reporters(StatefulProcessor):
    """Open periods of the reporters of a bucket, with a timer at the first instant that something of them is due.

    The state is one Arrow table of (key, first, last, kind): periods whose start is ``_OPEN`` or ``_TOLD``, and how far a
    reporter is ``_CLOSED`` as long as beats of a slot may reach back there.  So Python is called per bucket, not per reporter.
    """

    def __init__(self, timeout_us: int, buckets: int):
        self.timeout_us, self.buckets = timeout_us, buckets

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getValueState("rows", "rows binary")

    def close(self) -> None:
        pass

    def _load(self) -> pd.DataFrame | None:
        return pa.ipc.open_stream(self.rows.get()[0]).read_pandas() if self.rows.exists() else None

    def _save(self, rows: pd.DataFrame) -> None:
        if rows.empty:
            self.rows.clear()
            return
        table, sink = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        self.rows.update((sink.getvalue().to_pybytes(),))

    def _next(self, rows: pd.DataFrame) -> set[int]:
        instant = np.where(rows["kind"] == _OPEN, rows["first"], rows["last"] + self.timeout_us)
        return {int(_due(instant.min()))} if len(rows) else set()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self._load()
        closed = None if known is None else known[known["kind"] == _CLOSED]
        periods = None if known is None else known[known["kind"] != _CLOSED]
        for frame in rows:
            lo, hi = frame["lo"].to_numpy(), frame["hi"].to_numpy()
            who = frame["key"]
            if closed is not None and len(closed):
                # the early beats of a slot may be too late for a period that is over
                place = pd.Index(closed["key"]).get_indexer(pd.Index(who))
                lo = np.where((place >= 0) & (lo <= closed["last"].to_numpy()[place]), hi, lo)
            new = pd.DataFrame({"key": who.to_numpy(), "first": lo, "last": hi, "kind": np.int8(_OPEN)})
            periods = _joined(new if periods is None or periods.empty else pd.concat([periods, new], ignore_index=True), self.timeout_us)
        held = periods if closed is None or closed.empty else pd.concat([periods, closed], ignore_index=True)
        self._save(held)
        wanted, have = self._next(held), set(self.handle.listTimers())
        for due in have - wanted:
            self.handle.deleteTimer(due)
        for due in wanted - have:
            self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, held = timerValues.getCurrentWatermarkInMs(), self._load()
        if held is None:
            return
        end = held["last"] + self.timeout_us
        online = (held["kind"] == _OPEN) & (_due(held["first"]) < now)
        over = (held["kind"] != _CLOSED) & (_due(end) < now)
        # no beat that is not late reaches back to what a timeout closed before the watermark
        gone = (held["kind"] == _CLOSED) & (_due(end) < now)
        events = [pd.DataFrame({"known": int(key[0]) < self.buckets, "key": held["key"][rows], "event": event, "us": us[rows]})
                  for event, rows, us in (("online", online, held["first"]), ("offline", over, end)) if rows.any()]
        held["kind"] = held["kind"].mask(online, _TOLD).mask(over, _CLOSED).astype("int8")
        held["last"] = held["last"].mask(over, end)
        left = held[~gone & ~((held["kind"] == _CLOSED) & (_due(held["last"] + self.timeout_us) < now))]
        over_until = left[left["kind"] == _CLOSED].sort_values("last").drop_duplicates("key", keep="last")
        left = pd.concat([left[left["kind"] != _CLOSED], over_until], ignore_index=True)
        self._save(left)
        for due in self._next(left):
            self.handle.registerTimer(due)
        if events:
            yield pd.concat(events, ignore_index=True)


def stream_liveness_events(
    beats: DataFrame, folder: str, key: str = "worker_id", at: str = "ts", timeout: int = 120, late_by: str = "1 minute",
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Append ``online`` and ``offline`` events (key, event, at) to ``folder``/events.

    A reporter is online from its first beat until ``timeout`` seconds after its last one.  An event is given out
    when the watermark (the latest beat less ``late_by``) has passed it, so who is still online has an ``online`` and no
    ``offline`` yet, and beats may come in any order within ``late_by``: the events are those of ``period_events`` over
    ``live_sessions``.  Later beats are dropped.  Beats without a time are no beats; those without a key
    are those of one reporter.

    The state of a reporter is its open periods, in Spark's state store (RocksDB), with those of its bucket; only buckets
    with beats or a timer that is due are touched.
    """
    spark = beats.sparkSession
    timed = beats.select(F.col(key).alias("key"), F.col(at).cast("timestamp").alias("at")).filter("at is not null")
    kind = timed.schema["key"].dataType.simpleString()
    slots = timed.mapInArrow(slots_of(timeout), f"key {kind}, seen timestamp, lo long, hi long").withWatermark("seen", late_by)
    given = StructType([StructField("known", BooleanType()), StructField("key", timed.schema["key"].dataType), StructField("event", StringType()), StructField("us", LongType())])
    # beats without a key have a last bucket of their own, and no null in whole numbers, which pandas would make inexact
    bucket = F.when(F.col("key").isNotNull(), F.pmod(F.xxhash64("key"), F.lit(buckets))).otherwise(buckets)
    whole = isinstance(timed.schema["key"].dataType, IntegralType)
    slots = slots.withColumn("bucket", bucket).withColumn("key", F.coalesce("key", F.lit(0).cast(kind)) if whole else F.col("key"))
    events = slots.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_Reporters(timeout * 1_000_000, buckets), outputStructType=given, outputMode="Append", timeMode="EventTime")
    events = events.select(F.when(F.col("known"), F.col("key")).alias(key), "event", F.timestamp_micros("us").alias("at"))
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)  # a query keeps the settings it was started with
    try:
        return events.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").option(
            "path", f"{folder}/events").trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, before)
