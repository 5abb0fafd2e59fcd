"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from deskloom.checkpoints import Written, checkpointed

__all__ = ["Written", "checkpointed"]
#: Bytes of the rows that are turned into Python objects at a time, about; Spark bounds its Arrow batches by bytes itself.
SLICE_BYTES = 1 << 20
#: Rows of a table of a few numbers and a short string that may be broadcast.
BROADCAST_ROWS = 100_000


def small_batches(spark: SparkSession) -> None:
    """For applications, not operators: Arrow batches of SLICE_BYTES in this session, unless it asks for smaller ones.

    Spark's own bound of 64 MB holds for each batch that the JVM writes and a Python worker reads, so several at once for a
    task; executors with little memory beside the heap are better off with less.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(\d+)([a-z]*)", spark.conf.get(key).strip().lower()).groups()
    size = int(number) << {"k": 10, "m": 20, "g": 30, "t": 40}.get(unit[:1], 0)
    if size > SLICE_BYTES:
        spark.conf.set(key, str(SLICE_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a hint to broadcast it if it has at most so many rows, which are counted; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(prefix: str) -> str:
    """A column name that no input has."""
    return f"__{prefix}_{uuid.uuid4().hex[:8]}"


def slices(batch: pa.RecordBatch, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch's rows, in parts of about `size` bytes or a single row."""
    todo = [batch]
    while todo:
        part = todo.pop()
        if part.num_rows > 1 and part.nbytes > size:
            half = part.num_rows // 2
            todo += [part.slice(half), part.slice(0, half)]
        elif part.num_rows:
            yield part


def map_arrow(df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """rows applied to df's rows, a slice of bounded size at a time. Columns are handed over by place, so any names will do."""
    names = df.columns
    fields = schema.fields if isinstance(schema, StructType) else StructType.fromDDL(schema).fields
    places = [f"c{i}" for i in range(len(fields))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                if (out := rows(part.rename_columns(names))) is not None and out.num_rows:
                    yield out.rename_columns(places)

    plain = StructType([StructField(c, f.dataType) for c, f in zip(places, fields, strict=True)])
    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, plain).toDF(*[f.name for f in fields])


def runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts, and the length at the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def grouped_stream(
    batches: Iterator[pa.RecordBatch], key: Callable[[pa.RecordBatch], np.ndarray]
) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by key: all groups that end in a batch come in one table.

    Holds one batch and the group that is still open, so a caller that bounds its groups bounds the memory.
    """
    held: list[pa.RecordBatch] = []
    open_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = key(batch)
        if held and k[0] != open_key:
            yield pa.Table.from_batches(held)
            held = []
        if k[0] != k[-1]:
            last = int(np.flatnonzero(k != k[-1])[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held, batch = [], batch.slice(last)
        held.append(batch)
        open_key = k[-1]
    if held:
        yield pa.Table.from_batches(held)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of the component of each of 0..n-1 under the links a-b."""
    parent = np.arange(n)
    if not len(a):
        return parent
    while True:
        low = np.minimum(parent[a], parent[b])
        before = parent.copy()
        np.minimum.at(parent, parent[a], low)
        np.minimum.at(parent, parent[b], low)
        while True:  # follow the pointers to the roots
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        if np.array_equal(parent, before):
            return parent


def utf8(column: str):
    """The column as a string, null as the empty one."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
