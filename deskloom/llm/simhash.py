"""Operator 9: SimHash near-dedup with Golay-code fuzzy hashing.

Fingerprints of 64 bits link at 3 differing bits or fewer. They are cut into four segments of 16 bits. With at most 3
errors one segment has none, and of the two halves of the other 48 bits one has 1 at most. So a fingerprint's keys are,
for each segment and each half: the segment as it is, with indices of Golay codewords near to 23 of the half's bits.
The perfect Golay code has one codeword within 3 bits of each word. If a word is 2 bits or fewer from its codeword, every
word one bit away decodes to the same; if it is 3 away, they decode to that one or to one of the 5 codewords at 4 bits.
A fingerprint thus leads the buckets of its own codewords, 8 keys, and visits those of the others, 48 keys in all at
most; any linked pair meets in a bucket that one of the two leads. Fingerprints of a bucket are compared and verified.

Large buckets are dealt out as blocks, each pair of blocks to one task, and within a task links shrink to a spanning
forest, so that a group of near copies yields links in proportion to its size. Equal fingerprints are one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskloom.llm.common import checkpointed, forest, fresh, grouped_stream, map_arrow, runs, sized
from deskloom.operators.graph import components

WORDS, SEED, RADIUS = 3, 42, 3
#: Shingles that are hashed and counted at a time.
PART_SHINGLES = 1 << 16
#: Fingerprints of one block of a large bucket.
BLOCK = 4096
#: Runs up to this size are compared in step with each other, larger ones by blocks of rows.
SMALL_RUN, ROW_BLOCK = 12, 256
#: Generator polynomial of the binary Golay code of length 23: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """The SimHash of a text's word shingles; a text with fewer words is one shingle, one without words has 0."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    found = text.encode("utf-8").lower().split()  # of bytes: A-Z only, and white space as in ASCII
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, n, PART_SHINGLES):
        part = found[start : start + PART_SHINGLES + words - 1]
        shingles = zip(*(part[i:] for i in range(words)), strict=False) if len(found) >= words else [part]
        h = np.fromiter((digest(s, seed) for s in map(b" ".join, shingles)), "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprinted(df: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """df with one more column, a signed 64-bit fingerprint of each whole text; null is read as the empty text."""
    kept = [c for c in df.columns if c != out]
    given = fresh("text")
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(given))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.fromiter(map(fingerprint, batch.column(batch.num_columns - 1).to_pylist()), np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp)], names=[*batch.schema.names[:-1], out])

    return map_arrow(rows, run, df.select(*[F.col(f"`{c}`") for c in kept], F.lit(0).cast("long").alias(out)).schema)


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): a signed 64-bit fingerprint for each row's whole text; null is read as the empty text."""
    return fingerprinted(df.select(F.col(key), F.col(text).alias(f"{key} text")), f"{key} text").select(key, "fp")


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the error of 3 bits or fewer, and the 5 errors of 4 bits (0: none); syndromes of single bits."""
    unit = np.zeros(23, np.int64)
    for i in range(23):
        x = 1 << i
        while x.bit_length() > 11:
            x ^= GOLAY << (x.bit_length() - 12)
        unit[i] = x
    near, next_near = np.zeros(2048, np.int64), np.zeros((2048, 5), np.int64)
    for size in (1, 2, 3):
        for bits in combinations(range(23), size):
            near[np.bitwise_xor.reduce(unit[list(bits)])] = sum(1 << b for b in bits)
    filled = np.zeros(2048, np.int64)
    for bits in combinations(range(23), 4):
        s = np.bitwise_xor.reduce(unit[list(bits)])
        if int(near[s]).bit_count() == 3:
            next_near[s, filled[s]] = sum(1 << b for b in bits)
            filled[s] += 1
    syndrome = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
    for half, first in zip(syndrome, (0, 12), strict=True):
        for i in range(first, min(first + 12, 23)):
            at = np.arange(len(half)) >> (i - first) & 1 == 1
            half[at] ^= unit[i]
    return near, next_near, np.concatenate(syndrome)


def bucket_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of unsigned fingerprints, the index of the fingerprint of each, and whether it leads that bucket."""
    near, next_near, syndromes = golay()
    segments = [(fp >> np.uint64(16 * i) & np.uint64(0xFFFF)).astype(np.int64) for i in range(4)]
    rows = np.arange(len(fp))
    keys, owner, leads = [], [], []
    for i in range(4):
        others = [s for k, s in enumerate(segments) if k != i]
        rest = others[0] | others[1] << 16 | others[2] << 32
        for half in range(2):
            word = (rest >> (24 * half)) & 0x7FFFFF
            s = syndromes[word & 0xFFF] ^ syndromes[4096 + (word >> 12)]
            base = (2 * i + half) << 28 | segments[i] << 12
            keys.append(base | (word ^ near[s]) >> 11)
            owner.append(rows)
            leads.append(np.ones(len(fp), bool))
            for k in range(5):
                has = np.flatnonzero(next_near[s, k])
                keys.append(base[has] | (word[has] ^ next_near[s[has], k]) >> 11)
                owner.append(has)
                leads.append(np.zeros(len(has), bool))
    return np.concatenate(keys), np.concatenate(owner), np.concatenate(leads)


def linked(group: np.ndarray, node: np.ndarray, fp: np.ndarray, lead: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Links (pairs of nodes, as rows) that connect what the verified pairs of each run of equal groups connect.

    A pair counts if its fingerprints differ in RADIUS bits or fewer, one of the two leads, and their sides differ or
    are 0.
    """
    found: list[np.ndarray] = []
    edges = runs(group)
    sizes = np.diff(edges)
    small = np.repeat(sizes <= SMALL_RUN, sizes)
    for d in range(1, min(SMALL_RUN, len(group))):
        same = np.flatnonzero((group[d:] == group[:-d]) & small[d:])
        if not len(same):
            break
        ok = (lead[same] | lead[same + d]) & ((side[same] == 0) | (side[same] != side[same + d]))
        same = same[ok]
        same = same[np.bitwise_count(fp[same] ^ fp[same + d]) <= RADIUS]
        found.append(np.stack([node[same], node[same + d]], 1))
    for start, end in zip(edges[:-1][sizes > SMALL_RUN], edges[1:][sizes > SMALL_RUN], strict=True):
        f, own, s = fp[start:end], lead[start:end], side[start:end]
        parent = np.arange(len(f))
        for at in range(0, len(f), ROW_BLOCK):
            part = slice(at, at + ROW_BLOCK)
            ok = np.bitwise_count(f[part, None] ^ f[None, :]) <= RADIUS
            ok &= own[part, None] | own[None, :]
            ok &= (s[part, None] == 0) | (s[part, None] != s[None, :])
            i, k = np.nonzero(ok)
            parent = forest(np.concatenate([i + at, np.arange(len(f))]), np.concatenate([k, parent]), len(f))
        has = np.flatnonzero(parent != np.arange(len(f)))
        found.append(np.stack([node[start:end][has], node[start:end][parent[has]]], 1))
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return np.unique(np.sort(pairs, 1), axis=0)


def links(nodes: DataFrame, fp: str = "fp") -> DataFrame:
    """(a, b): links that connect the same fingerprints as all pairs with RADIUS differing bits or fewer do.

    The keys of all fingerprints are written once, for their counts and for the comparison.
    """

    def keyed(batch: pa.RecordBatch) -> pa.RecordBatch:
        key, owner, lead = bucket_keys(batch.column(0).to_numpy().view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(key), batch.column(0).take(pa.array(owner)), pa.array(lead)], names=["key", "fp", "lead"])

    keys = checkpointed(map_arrow(nodes.select(F.col(fp).alias("fp")), keyed, "key long, fp long, lead boolean"))
    shared = (
        keys.groupBy("key")
        .agg(F.count("*").alias("n"), F.max("lead").alias("led"))
        .where("n > 1 AND led")
        .select(F.col("key").bitwiseXOR(F.lit(1)).alias("turned"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    met = keys.join(shared, F.col("key").bitwiseXOR(F.lit(1)) == F.col("turned"))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = (
        met.withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("mine", "other").cast("long"))
        .withColumn("high", F.greatest("mine", "other").cast("long"))
        .select(
            (F.shiftleft("key", 32).bitwiseOR(F.shiftleft("low", 16)).bitwiseOR(F.col("high"))).alias("cell"), "fp", "lead",
            F.when(F.col("low") == F.col("high"), 0).when(F.col("mine") == F.col("low"), 1).otherwise(2).alias("side"),
        )
        .repartition("cell")
        .sortWithinPartitions("cell")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped_stream(batches, lambda b: b.column(0).to_numpy()):
            cell, value, lead, side = (c.to_numpy() for c in rows.columns)
            pairs = linked(cell, value, value.view(np.uint64), lead.astype(bool), side)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long")


def grouped(rows: DataFrame, key: str) -> DataFrame:
    """(own, least, root) for each fingerprint of rows (key, fp): its rows' smallest key, and its group's fingerprint."""
    nodes = checkpointed(rows.groupBy("fp").agg(F.min(key).alias("least")))
    reached = components(links(nodes))
    return nodes.join(reached, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("own"), "least", F.coalesce("component", "fp").alias("root"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id) for each row: its fingerprint and the smallest key that links lead to, its own included.

    Null texts count as empty; empty texts have fingerprint 0 and link like any other. Repeated rows each get a row. A
    row without a key has its group's component, null if no row of the group has a key. Texts of any length are read whole.
    An empty table gives an empty table. Other columns, whatever their names, are not carried.
    """
    rows = checkpointed(fingerprints(df.select(F.col(key).cast("long").alias(key), F.col(text)), key, text))
    groups = grouped(rows, key)
    lowest = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(groups.join(lowest, "root"), F.col("fp") == F.col("own")).select(key, "fp", "component_id")


def classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id), the fingerprint as 16 lowercase hex digits."""
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return near_duplicates(df, key, text).select(key, hexed.alias("fingerprint"), "component_id")


def representatives(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of df, with all its columns, for each group of linked fingerprints: the one with the smallest key, nulls last.

    Of rows that share a key, those whose fingerprints do not link are of different groups; of those that share key and
    fingerprint, one stays. Columns may have any names.
    """
    first, own, fp = fresh("first"), fresh("own"), fresh("fp")
    slim = checkpointed(fingerprints(df.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").alias("t")), "k", "t"))
    best = F.min(F.struct(F.col("least").isNull().alias("last"), F.col("least").alias("k"), F.col("own").alias("fp")))
    chosen = checkpointed(grouped(slim, "k").groupBy("root").agg(best.alias("c")).select("c.k", "c.fp"))
    again = checkpointed(slim.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select(F.col("k").alias(own)))
    long_key = F.col(f"`{key}`").cast("long")
    lone = chosen.select(F.col("k").alias(first)).where(F.col(first).isNotNull()).distinct().join(again, F.col(first) == F.col(own), "left_anti")
    once = df.join(lone, long_key == F.col(first), "left_semi")
    unclear = df.where(long_key.isNull()).unionAll(df.join(sized(again), long_key == F.col(own), "left_semi"))
    known = chosen.select(F.col("k").alias(first), F.col("fp").alias(own))
    picked = fingerprinted(unclear, text, fp).join(known, (F.col(fp) == F.col(own)) & long_key.eqNullSafe(F.col(first)), "left_semi")
    return once.unionAll(picked.dropDuplicates([fp]).select(*[F.col(f"`{c}`") for c in df.columns]))
