"""Micro-batches over a state table in hash buckets.

Each micro-batch reads the buckets of the state that hold its keys, computes its results with the same distributed
operators the batch jobs use, and writes these buckets again as the next version (``sources/buckets.py``): a batch
costs what it touches.  Its outputs go to ``<output>/batch_version=<batch id>`` first; the manifest of the state is
the commit.  A replayed batch without a manifest rewrites its outputs from the same inputs, one with a manifest is
done, so every result is stored exactly once, whichever executor or driver was lost.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from harvestry.sources import buckets as B
from harvestry.sources.sinks import write_version

Step = Callable[..., tuple[DataFrame, Mapping[str, DataFrame]]]


def start_batches(
    stream: DataFrame, folder: str, step: Step, keys: Sequence[str], first_state: DataFrame | None = None,
    available_now: bool = True, buckets: int = B.BUCKETS, id_col: str | None = None,
) -> StreamingQuery:
    """Start a query that advances the state table under ``folder`` with every micro-batch.

    ``step(state, batch)`` sees all state rows of the ``keys`` in the batch (and others of their buckets) and gives
    back what these buckets hold next, and the outputs.  No row may depend on rows of other keys.  With ``id_col``
    the step also gets ``top``, the highest id that the whole table ever had.
    """
    state_folder = f"{folder}/state"

    def advance(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = B.versions(spark, state_folder)
        if batch_id in done:
            return
        if not done and first_state is not None:
            B.write_buckets(first_state, state_folder, -1, keys, buckets=buckets, id_col=id_col)
            done = [-1]
        before = B.open_version(spark, state_folder, done[-1]) if done else None
        batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            touched = [] if before is None else B.touched_buckets(batch, keys, before.buckets)
            known = None if before is None else B.read_version(spark, state_folder, before, touched)
            top = {} if id_col is None else {"top": before.highest or 0 if before else 0}
            state, outputs = step(known, batch, **top)
            for name, rows in outputs.items():
                write_version(rows, f"{folder}/{name}", batch_id)
            B.write_buckets(state, state_folder, batch_id, keys, before, touched, buckets, id_col)
            B.forget_versions(spark, state_folder)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(advance).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def finished_versions(spark: SparkSession, folder: str) -> list[int]:
    """Batches whose state can be read, ascending."""
    return B.versions(spark, f"{folder}/state")


def read_output(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """All rows an output received so far."""
    return spark.read.option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}").drop("batch_version")


def read_state(spark: SparkSession, folder: str, query: StreamingQuery | None = None) -> DataFrame:
    """The state after the last finished micro-batch, also of a query that was started again without new data."""
    return B.read_version(spark, f"{folder}/state", B.open_version(spark, f"{folder}/state"))
