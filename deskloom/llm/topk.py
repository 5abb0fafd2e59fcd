"""Operator 10: exact top-k search by inner product, with multi-resolution segment statistics.

A vector is cut into segments of equal length, first few and long ones, then more and shorter ones. The means m and the
deviations s of two vectors' segments bound their squared distance from below by the sum of L * ((m - m')^2 + (s - s')^2),
so, the norms being known, their inner product from above. Candidates whose bound cannot reach the query's k-th best so
far are dropped, coarse to fine, and the exact integer product is computed for those left.

A task holds one block of queries of a bounded size and k rows for each, and reads candidates in slices. Queries that fit into
one block are broadcast, and the candidates stay where they are. More queries are dealt out in blocks, and candidates in shares:
each pair of a block and a share is a group of rows, its queries first, that one task reads as a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deskloom.llm.common import checkpointed, map_arrow, runs, slices

K, EVERY, SCALE = 5, 50, 256
#: Bytes of a block of queries, and of the share of candidates that one task compares with a block.
QUERY_BYTES, SHARE_BYTES = 16 << 20, 256 << 20
#: Pairs of a query and a candidate that are held as numbers at a time.
PAIRS = 1 << 20
#: Segments of each level, coarse to fine; levels with segments shorter than two components are left out.
LEVELS = (4, 16, 32)
#: Below this share of survivors, exact products are computed pair by pair.
SPARSE = 0.05
LOWEST = -(1 << 63)


def quantised(df: DataFrame, key: str, embedding: str, scale: int) -> DataFrame:
    """(vec_id, dim, v): floor(scale * x) of each component as packed doubles; rows that take no part are left out."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [None if x is None or None in x else np.floor(scale * np.array(x, np.float64)) for x in batch.column(1).to_pylist()]
        ok = [i for i, v in enumerate(out) if v is not None and np.isfinite(v).all()]
        columns = [batch.column(0).take(pa.array(ok, pa.int64())), pa.array([len(out[i]) for i in ok], pa.int32()), pa.array([out[i].tobytes() for i in ok], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["vec_id", "dim", "v"])

    return map_arrow(rows, run, "vec_id long, dim int, v binary")


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose products are the bounds: each segment's mean and deviation, times the root of its length.

    Components beyond the last whole segment are a segment of their own.
    """
    length = x.shape[1] // segments
    cuts = [x[:, : length * segments].reshape(len(x), segments, length), x[:, length * segments :].reshape(len(x), 1, -1)]
    out = []
    for part in cuts:
        if n := part.shape[2]:
            mean = part.mean(axis=2)
            out += [mean * n**0.5, np.sqrt(np.maximum(((part - mean[:, :, None]) ** 2).mean(axis=2), 0)) * n**0.5]
    return np.concatenate(out, axis=1)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of the rows of a with those of b; beyond 64 bits they are clipped."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if bound < 2**53:  # every sum of doubles is exact
        return (a @ b.T).astype(np.int64)
    whole = [[sum(int(p) * int(q) for p, q in zip(r, s, strict=True)) for s in b] for r in a]
    return np.array([[min(max(x, LOWEST), -LOWEST - 1) for x in r] for r in whole], np.int64).reshape(len(a), len(b))


class Best:
    """The k best candidates of each query so far; ties go to the smaller id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.x, self.k = ids, vectors, k
        self.floor = np.full(len(ids), LOWEST, np.int64) if floor is None else floor.copy()
        self.levels = [s for s in LEVELS if vectors.shape[1] // s >= 2]
        self.stats = [statistics(vectors, s) for s in self.levels]
        self.safe = float(np.abs(vectors).max(initial=0)) < 2**40
        self.held = np.zeros(len(ids), np.int64)
        self.score, self.who = np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k), np.int64)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Takes candidates in, a slice at a time, so that no more than about PAIRS numbers are held."""
        step = max(16, PAIRS // max(1, len(self.ids)))
        for at in range(0, len(ids), step):
            self._add(ids[at : at + step], x[at : at + step])

    def _add(self, ids: np.ndarray, x: np.ndarray) -> None:
        alive = np.ones((len(self.ids), len(ids)), bool)
        if self.safe and float(np.abs(x).max(initial=0)) < 2**40:
            for segments, own in zip(self.levels, self.stats, strict=True):
                cols = np.flatnonzero(alive.any(axis=0))
                if not len(cols):
                    return
                bound = own @ statistics(x[cols], segments).T
                alive[:, cols] &= bound + np.abs(bound) * 1e-9 + 1e-6 >= self.floor[:, None]
        alive &= ids[None, :] != self.ids[:, None]
        cols = np.flatnonzero(alive.any(axis=0))
        rows = np.flatnonzero(alive.any(axis=1))
        if not len(cols):
            return
        alive = alive[np.ix_(rows, cols)]
        bound = float(np.abs(self.x).max()) * float(np.abs(x).max()) * x.shape[1]
        if alive.mean() < SPARSE and bound < 2**53:
            score = np.full(alive.shape, LOWEST, np.int64)
            i, j = np.nonzero(alive)
            for at in range(0, len(i), 1 << 16):
                a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                score[a, b] = np.einsum("ij,ij->i", self.x[rows[a]], x[cols[b]]).astype(np.int64)
        else:
            score = exact(self.x[rows], x[cols])
        alive &= score >= self.floor[rows, None]
        hit = np.flatnonzero(alive.any(axis=1))
        if len(hit):
            self._keep(rows[hit], score[hit], alive[hit], ids[cols])

    def _keep(self, rows: np.ndarray, score: np.ndarray, alive: np.ndarray, ids: np.ndarray) -> None:
        """The k best of what the queries at `rows` hold and of the candidates that are alive for them."""
        void = np.concatenate([np.arange(self.k) >= self.held[rows, None], ~alive], axis=1)
        score = np.concatenate([self.score[rows], score], axis=1)
        who = np.concatenate([self.who[rows], np.broadcast_to(ids, alive.shape)], axis=1)
        order = np.lexsort((who, ~score, void), axis=1)[:, : self.k]
        self.score[rows], self.who[rows] = np.take_along_axis(score, order, 1), np.take_along_axis(who, order, 1)
        self.held[rows] = np.minimum(self.k, (~void).sum(axis=1))
        full = rows[self.held[rows] == self.k]
        self.floor[full] = np.maximum(self.floor[full], self.score[full, -1])

    def rows(self) -> pa.RecordBatch:
        r, c = np.nonzero(np.arange(self.k) < self.held[:, None])
        return pa.RecordBatch.from_arrays([pa.array(self.ids[r]), pa.array(self.who[r, c]), pa.array(self.score[r, c])], names=["query_id", "vec_id", "score"])


def search(
    df: DataFrame, key: str = "vec_id", embedding: str = "embedding", k: int = K, every: int = EVERY, scale: int = SCALE
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose key is divisible by `every`, its k best other rows.

    Scores are inner products of the vectors floor(scale * x), as integers; ties go to the smaller vec_id. Vectors that are
    null, empty or hold nulls or numbers that are not finite, themselves or times `scale`, and rows without a key, take no part;
    vectors of different lengths are not compared. A zero vector takes part. A key should be unique: of rows that repeat one, a
    query's is its first, and rows with the query's own key are no candidates, while repeated candidates are one each. A query
    without candidates has no rows. Negative keys are keys like others. Other columns, whatever their names, are not carried.
    """
    rows = checkpointed(quantised(df, key, embedding, scale).where("dim > 0"))
    queries = checkpointed(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("q")).select("vec_id", "q.dim", "q.v"))
    size = queries.agg(F.coalesce(F.sum(F.col("dim") * 8), F.lit(0))).first()[0]
    found = _broadcast(rows, queries, k) if size <= QUERY_BYTES else _dealt(rows, queries, k)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


FOUND = "query_id long, vec_id long, score long"


class Searches:
    """One block of queries, by the length of their vectors, and their best candidates so far."""

    def __init__(self, k: int):
        self.k, self.given, self.best = k, {}, {}

    def ask(self, batch: pa.RecordBatch) -> None:
        for dim, ids, x in _by_length(batch):
            self.given.setdefault(dim, []).append((ids, x))

    def add(self, batch: pa.RecordBatch) -> None:
        for dim, ids, x in _by_length(batch):
            if dim in self.given and dim not in self.best:
                own = self.given[dim]
                self.best[dim] = Best(np.concatenate([i for i, _ in own]), np.concatenate([v for _, v in own]), self.k)
            if dim in self.best:
                self.best[dim].add(ids, x)

    def rows(self) -> Iterator[pa.RecordBatch]:
        for best in self.best.values():
            if (out := best.rows()).num_rows:
                yield out


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, keys, vectors) of a batch (vec_id, dim, v), for each length."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        part = batch.filter(pa.array(dims == dim))
        yield dim, part.column("vec_id").to_numpy(), np.frombuffer(b"".join(part.column("v").to_pylist()), np.float64).reshape(-1, dim)


def _broadcast(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best of each query in every partition of the candidates; all queries are one block."""
    table = queries.select("vec_id", "dim", "v").toArrow().combine_chunks()
    shared = rows.sparkSession.sparkContext.broadcast(table)  # QUERY_BYTES at most, about

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = Searches(k)
        for batch in shared.value.to_batches():
            searches.ask(batch)
        for batch in batches:
            for part in slices(batch):
                searches.add(part)
        yield from searches.rows()

    return rows.select("vec_id", "dim", "v").mapInArrow(run, FOUND)


def _dealt(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best of each query in every share of the candidates; a block meets a share in one task."""
    sums = [x.agg(F.coalesce(F.sum(F.col("dim") * 8), F.lit(0))).first()[0] for x in (queries, rows)]
    blocks, shares = -(-sums[0] // QUERY_BYTES), max(1, -(-sums[1] // SHARE_BYTES))
    mine = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("long")
    everywhere = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = queries.select("vec_id", "dim", "v", mine(blocks, 1).alias("block"), everywhere(shares).alias("share"), F.lit(0).alias("side"))
    given = rows.select("vec_id", "dim", "v", mine(shares, 2).alias("share"), everywhere(blocks).alias("block"), F.lit(1).alias("side"))
    dealt = (
        asked.unionByName(given)
        .withColumn("task", F.col("block") * shares + F.col("share"))
        .repartition("task")
        .sortWithinPartitions("task", "side")
        .select("task", "side", "vec_id", "dim", "v")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, searches = None, Searches(k)
        for batch in batches:
            for part in slices(batch):
                cell = part.column("task").to_numpy() * 2 + part.column("side").to_numpy()
                edges = runs(cell)
                for start, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    task, side = divmod(int(cell[start]), 2)
                    if task != now:
                        yield from searches.rows()
                        now, searches = task, Searches(k)
                    (searches.add if side else searches.ask)(part.slice(start, end - start))
        yield from searches.rows()

    return dealt.mapInArrow(run, FOUND)
