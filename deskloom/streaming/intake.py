"""Streaming intake (X05, X07, S14): first write wins, late rows leave, with a bounded state."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def first_writes(stream: DataFrame, key: str, at: str, delay: str = "1 hour") -> DataFrame:
    """Rows whose key was not seen within the watermark; state older than it is dropped."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, by: str, size: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Rows per half-open window and group; rows later than the watermark are left out."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, size), by).agg(F.count("*").alias("n"))


def append_new(target: str, key: str):
    """A foreachBatch function that appends rows whose key the Parquet table at target lacks; replays change nothing.

    One stream writes to a target: two at once could both find a key missing. The keys of the target are read for each batch,
    but only those that the batch has go on to the join, so partition the target by something that prunes them if it is large.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        new = batch.dropDuplicates([key])
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            seen = spark.read.parquet(target).select(key).join(new.select(key), key, "left_semi").distinct()
            new = new.join(seen, key, "left_anti")
        new.write.mode("append").parquet(target)

    return write


class _First(StatefulProcessor):
    """Per key: whether it was written, for as long as the state lives."""

    def __init__(self, order: str, columns: list[str], ttl: int | None) -> None:
        self.order, self.columns, self.ttl = order, columns, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "written boolean", self.ttl)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        self.seen.update((True,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.seen.exists():
            return
        best = None
        for batch in rows:
            both = batch if best is None else pd.concat([best, batch])
            best = both.sort_values([self.order, *[c for c in self.columns if c != self.order]], kind="stable").head(1)
        if best is not None:
            self.seen.update((True,))
            yield best[self.columns]

    def close(self) -> None:
        pass


def first_writes_kept(stream: DataFrame, key: str, order: str, known: DataFrame | None = None, ttl: timedelta | None = None) -> DataFrame:
    """The first row of each key, in `order` within a batch, then the rest of its columns; later ones of the key change nothing.

    What was written is keyed state, dealt out over tasks: a batch reads and writes the state of its own keys only, whatever the
    target has grown to. After `ttl` of processing time a key is forgotten, which bounds the state; without it each key stays. A
    run with a new checkpoint starts from `known`, a table with the key, such as the target itself, read once at its start.
    With a file sink, replays of a batch change nothing either. A null key is a key like others. Needs the RocksDB state store;
    with `ttl` and the trigger availableNow, set spark.sql.streaming.noDataMicroBatches.enabled to false, or the run doesn't end.
    """
    millis = None if ttl is None else int(ttl.total_seconds() * 1000)
    start = None if known is None else known.select(key).distinct().groupBy(key)
    first = _First(order, stream.columns, millis)
    return stream.groupBy(key).transformWithStateInPandas(first, stream.schema, "Append", "None" if ttl is None else "ProcessingTime", start)
