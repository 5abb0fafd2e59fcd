"""Operator 1: embedding near-dedup within spherical k-means cells.

Vectors link when their labels are equal and their cosine, in double precision, is at least the threshold. k-means on a
bounded sample gives cell centres; every vector has its home in its nearest cell, and visits each cell of lower number in
which a partner could have its home. Whether one could is decided by bounds that never lose a link: a partner is at most
`angle` away, so the vector is at most `angle` from the plane between the two centres, and its own angle to the centre is
within `angle` of those of the cell's members. Within a label's cell, blocks of homes are compared with each other and
with blocks of visitors as matrix products; a task holds two blocks, whatever the size of a cell. It returns the number
of links of each vector and a spanning forest, never the pairs. Equal vectors of a label are one node with a weight.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskloom.llm.common import checkpointed, forest, grouped_stream, map_arrow, sized
from deskloom.operators.graph import components

THRESHOLD = 0.98
#: The centres are fitted on at most so many vectors; every vector is then assigned.
SAMPLE = 8192
#: Bytes of one block of vectors in a comparison, and rows that are multiplied at a time.
BLOCK_BYTES, ROWS = 1 << 20, 512
#: What copying a vector to a cell costs, in comparisons of two vectors; used to choose the number of cells.
COPY_COST = 2000
MIN_CELLS, MAX_CELLS, ROUNDS = 8, 1024, 10
#: Slack of the bounds, far above the rounding of doubles.
SLACK = 1e-7


def vectors(df: DataFrame, key: str, embedding: str, label: str, kind: str) -> DataFrame:
    """(key, label, vkey, dim, vec): vec is the vector's numbers, packed; null, as vkey, if it can't link with anything."""
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("v"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        vecs, keys, dims = [], [], []
        for x, group in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True):
            v = None if x is None or group is None or None in x else np.array(x, np.float64) + 0.0
            if v is None or not np.isfinite(v).all() or not v.any():
                vecs.append(None), keys.append(None), dims.append(0)
                continue
            vecs.append(v.astype(kind).tobytes())
            keys.append(hashlib.md5(vecs[-1], usedforsecurity=False).digest())
            dims.append(len(v))
        columns = [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "vkey", "dim", "vec"])

    return map_arrow(rows, run, "vec_id long, label string, vkey binary, dim int, vec binary")


def unit(packed: list[bytes], kind: str) -> np.ndarray:
    """Rows of unit length, in double precision; scaled first, so that no square overflows or vanishes."""
    x = np.frombuffer(b"".join(packed), kind).astype(np.float64).reshape(len(packed), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k unit centres by spherical k-means, started from evenly spaced rows; empty cells keep their centre."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.sqrt((sums * sums).sum(axis=1))
        ok = size > 1e-9
        centres[ok] = sums[ok] / size[ok, None]
    return centres


class Cells:
    """Centres with the bounds by which vectors visit them."""

    def __init__(self, centres: np.ndarray, angle: float):
        self.centres, self.angle = centres, angle
        self.apart = np.maximum(np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0)), 1e-12)
        self.low, self.high = np.zeros(len(centres)), np.full(len(centres), np.pi)

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's cell and its angle to the centre."""
        near = x @ self.centres.T
        own = near.argmax(axis=1)
        return own, np.arccos(np.clip(near[np.arange(len(x)), own], -1, 1))

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home cells; and rows with the lower cells that a partner may have as its home."""
        near = x @ self.centres.T
        own = near.argmax(axis=1)
        angles = np.arccos(np.clip(near, -1, 1))
        may = (angles <= self.high + self.angle + SLACK) & (angles >= self.low - self.angle - SLACK)
        may &= near[np.arange(len(x)), own][:, None] - near <= (np.sin(self.angle) + SLACK) * self.apart[own]
        may &= np.arange(len(self.centres)) < own[:, None]
        return own, *np.nonzero(may)


def choose(sample: np.ndarray, n: int, labels: int, angle: float) -> Cells:
    """Centres whose number, a power of two, costs least for n vectors by the sample's visits."""
    best, least = Cells(fit(sample, 1), angle), np.inf
    k = MIN_CELLS
    while k <= min(MAX_CELLS, len(sample) // 8):
        cells = Cells(fit(sample, k), angle)
        own, at = cells.home(sample)
        for c in range(k):
            mine = at[own == c]
            cells.low[c], cells.high[c] = (mine.min(), mine.max()) if len(mine) else (1, 0)
        copies = 1 + len(cells.visits(sample)[1]) / len(sample)
        cost = copies * (n / k / labels + COPY_COST)
        if cost < least:
            best, least = Cells(cells.centres, angle), cost
        k *= 2
    return best


def compare(first: np.ndarray, second: np.ndarray, inner: bool, threshold: float, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted numbers of links of the rows of first, then second; and each row's root in a spanning forest.

    Rows of first are compared with those of second, and with each other if inner.
    """
    n, m = len(first), len(second)
    counts, parent = np.zeros(n + m), np.arange(n + m)
    both = np.concatenate([first, second]) if inner else second
    shift = 0 if inner else n
    for at in range(0, n, ROWS):
        i, k = np.nonzero(first[at : at + ROWS] @ both.T >= threshold)
        i, k = i + at, k + shift
        keep = i != k
        i, k = i[keep], k[keep]
        counts[:n] += np.bincount(i, weights[k], n)
        counts[n:] += np.bincount(k[k >= n] - n, weights[i[k >= n]], m)
        parent = forest(np.concatenate([i, np.arange(n + m)]), np.concatenate([k, parent]), n + m)
    return counts.astype(np.int64), parent


def near_duplicates(
    df: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row.

    n_links counts the other vectors with an equal label and a cosine of at least threshold; component_id is the smallest
    vec_id that links lead to, its own included; kept marks the rows whose own it is. Vectors with a null label, and those
    that are null, zero, empty or hold nulls or non-finite numbers, have no links; vectors of different lengths do not
    link. The key is taken as unique: rows that repeat one with an equal vector count as copies. Rows with a null key
    have no links, a null component_id and are not kept. Extra columns are not carried.
    """
    angle = float(np.arccos(threshold))
    kind = "<f4" if dict(df.dtypes)[embedding] == "array<float>" else "<f8"
    rows = checkpointed(vectors(df, key, embedding, label, kind))
    nodes = checkpointed(
        rows.where("vkey IS NOT NULL AND vec_id IS NOT NULL")
        .groupBy("label", "vkey")
        .agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("vec").alias("vec"), F.first("dim").alias("dim"))
        .drop("vkey")
    )
    sizes = {r["dim"]: r for r in nodes.groupBy("dim").agg(F.count("*").alias("n"), F.approx_count_distinct("label").alias("labels")).orderBy(F.desc("n")).limit(100).collect()}
    main = next(iter(sizes), 0)  # cells are fitted for the commonest length; vectors of others share one cell
    sample = nodes.where(F.col("dim") == main).select("vec").orderBy(F.xxhash64("vec")).limit(SAMPLE).collect()
    cells = None
    if sample:
        cells = choose(unit([r["vec"] for r in sample], kind), sizes[main]["n"], max(1, sizes[main]["labels"]), angle)

        def at_home(batch: pa.RecordBatch) -> pa.RecordBatch:
            own, at = cells.home(unit(batch.column(0).to_pylist(), kind))
            return pa.RecordBatch.from_arrays([pa.array(own), pa.array(at)], names=["cell", "at"])

        near = map_arrow(nodes.where(F.col("dim") == main).select("vec"), at_home, "cell long, at double")
        bounds = near.groupBy("cell").agg(F.min("at").alias("low"), F.max("at").alias("high")).collect()  # a row for each centre at most
        cells.low[:], cells.high[:] = 1, 0
        for r in bounds:
            cells.low[r["cell"]], cells.high[r["cell"]] = r["low"], r["high"]

    def placed(batch: pa.RecordBatch) -> pa.RecordBatch:
        dims, packed = batch.column("dim").to_numpy(), batch.column("vec").to_pylist()
        at = np.flatnonzero(dims == main)
        home = np.zeros(len(dims), np.int64)
        rows, cell = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(at):
            home[at], rows, cell = cells.visits(unit([packed[i] for i in at], kind))
            rows = at[rows]
        take = pa.array(np.concatenate([np.arange(len(dims)), rows]))
        is_home = np.concatenate([np.ones(len(dims), bool), np.zeros(len(rows), bool)])
        columns = [batch.column(c).take(take) for c in ("node", "label", "dim")] + [pa.array(np.concatenate([home, cell])), pa.array(is_home)]
        return pa.RecordBatch.from_arrays(columns, names=["place", "label", "dim", "cell", "home"])

    # written once, without the vectors, for the counts and for the comparison
    placements = checkpointed(map_arrow(nodes.select("node", "label", "dim", "vec"), placed, "place long, label string, dim int, cell long, home boolean"))
    block = F.greatest(F.lit(64), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dim"))))
    filled = placements.groupBy("label", "dim", "cell").agg(
        F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("visitors")
    )
    filled = filled.where("homes > 0 AND homes + visitors > 1").select(
        F.col("label").alias("l"), F.col("dim").alias("d"), F.col("cell").alias("c"),
        F.ceil(F.col("homes") / block).cast("int").alias("h"), F.ceil(F.col("visitors") / block).cast("int").alias("v"),
    )
    # by a hash of the cell, so that both sides are dealt out anew and a hot cell can be split; few cells are broadcast
    same = (F.xxhash64("label", "dim", "cell") == F.col("key")) & (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d")) & (F.col("cell") == F.col("c"))
    met = placements.join(sized(filled.withColumn("key", F.xxhash64("l", "d", "c"))), same).drop("label", "dim")
    met = met.join(nodes, F.col("place") == F.col("node"))
    # homes have blocks 0 .. h-1, visitors h .. h+v-1; the first block of visitors goes where a block of homes meets itself
    mine = F.when(F.col("home"), F.pmod(F.xxhash64("node"), F.col("h"))).otherwise(F.pmod(F.xxhash64("node"), F.col("v")) + F.col("h"))
    met = met.withColumn("mine", mine.cast("int")).withColumn("first", F.col("mine") == F.col("h"))
    others = F.when(F.col("home"), F.filter(F.sequence(F.lit(0), F.greatest(F.col("h"), F.col("h") + F.col("v") - 1)), lambda x: x != F.col("h")))
    dealt = (
        met.withColumn("other", F.explode(others.otherwise(F.sequence(F.lit(0), F.col("h") - 1))))
        .withColumn("low", F.least("mine", "other"))
        .withColumn("high", F.when(F.col("first"), F.col("other")).otherwise(F.greatest("mine", "other")))
        .select(
            F.concat_ws("|", "low", "high", "cell", "dim", "label").alias("task"), "node", "copies", "vec",
            F.when(F.col("first"), 2).when(F.col("low") == F.col("high"), 0).when(F.col("mine") == F.col("low"), 1).otherwise(2).alias("side"),
        )
        .repartition("task")
        .sortWithinPartitions("task")
    )

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in grouped_stream(batches, lambda b: b.column(0).to_numpy(zero_copy_only=False)):
            task = groups.column(0).to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(task[1:] != task[:-1]) + 1, [len(task)]])
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                part = groups.slice(start, end - start)
                side = part.column("side").to_numpy()
                if len(side) < 2 or (side.min() and (side == side[0]).all()) or side.min() == 2:
                    continue
                order = np.argsort(side, kind="stable")
                node, weight = part.column("node").to_numpy()[order], part.column("copies").to_numpy()[order]
                packed = part.column("vec").to_pylist()
                x = unit([packed[i] for i in order], kind)
                cut = int((side < 2).sum())
                counts, parent = compare(x[:cut], x[cut:], not side.min(), threshold, weight)
                has = np.flatnonzero(counts)
                if len(has):
                    yield pa.RecordBatch.from_arrays([pa.array(node[has]), pa.array(counts[has]), pa.array(node[parent[has]])], names=["node", "links", "root"])

    found = checkpointed(dealt.mapInArrow(matched, "node long, links long, root long"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links")).withColumnRenamed("node", "linked")
    reached = components(found, "node", "root").withColumnRenamed("node", "reached")
    # a vector's copies have its links and those to each other
    alike = (
        rows.where("vkey IS NOT NULL AND vec_id IS NOT NULL")
        .groupBy("label", "vkey").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
        .join(counts, F.col("node") == F.col("linked"), "left")
        .join(reached, F.col("node") == F.col("reached"), "left")
        .select(
            F.col("label").alias("l"), F.col("vkey").alias("k"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "node").alias("c"),
        )
    )
    return rows.join(alike, (F.col("label") == F.col("l")) & (F.col("vkey") == F.col("k")) & F.col("vec_id").isNotNull(), "left").select(
        F.col("vec_id").alias(key),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("c", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("c", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
