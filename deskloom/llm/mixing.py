"""Operator 2: mixing sources to target weights.

A source's weight is its share of all tokens to the power of an exponent, normalised. The exponent is the smallest one in
[0, 1] (1 keeps the shares, 0 makes them even) at which the weights' entropy and the most repeated source stay within their
targets; both fall as it rises, so it is bracketed more and more closely, each round one aggregation for many exponents.

A source is passed over as often as its part of the budget asks. Each pass goes through its documents in the order of a
permutation of blocks, and of the documents within each; the last one ends where the budget does. Blocks have a bounded
number of documents, so positions come from one small window over a source's blocks and one within each block.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deskloom.llm.common import checkpointed, fresh, sized

#: Production parameters: the least repeated source is passed over MIN_PASSES times, the most repeated MAX_REPEATS times.
MAX_REPEATS, MIN_PASSES = 2.0, 1.0
#: Documents of a block, about; exponents tried in one round, and rounds.
BLOCK_DOCS, GRID, ROUNDS = 4096, 32, 6
SEED = 17


def words(text: str = "text"):
    """The tokens of a text for shares and budgets: its runs of characters other than ASCII white space; null has none."""
    return F.greatest(F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def solve(shares: DataFrame, entropy: float | None = None, max_repeats: float | None = None, min_passes: float = MIN_PASSES, budget: float | None = None) -> float:
    """The smallest exponent in [0, 1] within the targets, from a table (tokens) of sources with tokens.

    budget is in all sources' tokens; without it, the least repeated source is passed over min_passes times.
    """
    total = shares.agg(F.sum("tokens").alias("t"), F.min("tokens").alias("low"), F.max("tokens").alias("high")).first()
    if not total["t"] or total["low"] == total["high"] and budget is None:
        return 1.0
    p = F.col("tokens") / F.lit(float(total["t"]))
    low, high = 0.0, 1.0

    def within(exponent: float, z: float, s: float) -> bool:
        if entropy is not None and math.log(z) - exponent * s / z > entropy:
            return False
        if max_repeats is None:
            return True
        least = total["low"] / total["t"]
        passes = (total["high"] / total["low"]) ** (1 - exponent) * min_passes if budget is None else least ** (exponent - 1) / z * budget / total["t"]
        return passes <= max_repeats

    for _ in range(ROUNDS):
        grid = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        sums = [x for e in grid for x in (F.sum(F.pow(p, F.lit(e))), F.sum(F.pow(p, F.lit(e)) * F.log(p)))]
        row = shares.agg(*[x.alias(f"s{i}") for i, x in enumerate(sums)]).first()
        ok = [i for i, e in enumerate(grid) if within(e, row[2 * i], row[2 * i + 1])]
        if not ok:
            return 1.0  # even the shares as they are go beyond the targets
        if ok[0] == 0:
            return grid[0]
        low, high = grid[ok[0] - 1], grid[ok[0]]
    return high


def mix(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", entropy: float | None = None,
    max_repeats: float | None = MAX_REPEATS, min_passes: float = MIN_PASSES, budget: float | None = None, seed: int = SEED,
    tokens: str | None = None, prefix: str = "mix_",
) -> DataFrame:
    """docs with rows taken as often as the mixture asks, and four more columns, which say where each stands.

    mix_pass (from 0) and mix_position (from 0 within source and pass) are the row's place in its source's permutation,
    mix_block is its block; by mix_order, from 0 to 1, all rows stand in training order, sources interleaved by weight.

    With min_passes of 1 or more and no budget, every document is taken once or more. A null source is a source, null keys are
    keys, null texts are empty, and equal rows are documents of their own. Sources whose texts have no tokens are passed over
    once, as they cost nothing. An empty table gives an empty table. `tokens` names a column with the documents' numbers of
    tokens; without it, words() counts them. Columns of docs that begin with `prefix` and are named like the four are
    replaced; any other names do not matter.
    """
    names = [f"{prefix}{x}" for x in ("pass", "block", "position", "order")]
    kept = [c for c in docs.columns if c not in names]
    s, h, x, b, n, turn = (fresh(c) for c in ("source", "hash", "text", "block", "tokens", "turn"))  # columns that docs can't have
    rows = docs.select(
        *[F.col(f"`{c}`") for c in kept],
        F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("null")).alias(s),
        F.xxhash64(F.lit(seed), F.col(f"`{key}`").cast("string"), F.col(f"`{text}`").cast("string")).alias(h),
        (F.col(f"`{text}`").cast("string") if tokens is None else F.col(f"`{tokens}`").cast("long")).alias(x),
    )
    size = words(x) if tokens is None else F.coalesce(x, F.lit(0))
    sizes = checkpointed(rows.groupBy(F.col(s).alias(turn)).agg(F.ceil(F.count("*") / BLOCK_DOCS).alias(n)))
    blocked = rows.join(sized(sizes), F.col(s) == F.col(turn)).withColumn(b, F.pmod(h, n)).drop(turn, n)
    blocks = checkpointed(blocked.groupBy(F.col(s).alias("s"), F.col(b).alias("b")).agg(F.sum(size).alias("tokens"), F.count("*").alias("docs")))
    sources = checkpointed(blocks.groupBy("s").agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs")))
    counted = sources.where("tokens > 0")
    exponent = solve(counted, entropy, max_repeats, min_passes, budget)
    sums = counted.agg(F.sum("tokens").alias("t"), F.max("tokens").alias("high")).first()
    total, high = float(sums["t"] or 1), float(sums["high"] or 1)
    if budget is None:
        passes = F.pow(F.col("tokens") / high, F.lit(exponent - 1)) * min_passes
    else:
        z = counted.agg(F.sum(F.pow(F.col("tokens") / total, F.lit(exponent)))).first()[0] or 1.0
        passes = F.pow(F.col("tokens") / total, F.lit(exponent)) / z * budget / F.col("tokens")
    passes = F.round(F.when(F.col("tokens") > 0, passes).otherwise(1.0), 9)  # whole passes do not miss by rounding
    plan = sources.select(
        F.col("s").alias("ps"), (passes * F.col("docs")).alias("taken"), F.col("docs").alias("of"),
        F.floor(passes).cast("int").alias("full"), ((passes - F.floor(passes)) * F.col("tokens")).alias("rest"),
    )
    # each pass has its own permutation of the source's blocks; the last one ends where the budget does, within a block
    order = Window.partitionBy("s", "pass").orderBy(F.xxhash64(F.lit(seed), "s", "b", "pass"), "b").rowsBetween(Window.unboundedPreceding, 0)
    turns = (
        blocks.join(plan, F.col("s") == F.col("ps"))
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("full"))))
        .withColumn("end", F.sum("tokens").over(order))
        .withColumn("first", F.sum("docs").over(order) - F.col("docs"))
        .withColumn("left", F.when(F.col("pass") == F.col("full"), F.col("rest") - F.col("end") + F.col("tokens")))
        .where("left IS NULL OR left > 0")
    )
    turns = checkpointed(
        turns.select(
            "s", "b",
            F.struct(
                "pass", "first", (F.col("pass") * F.col("of")).alias("earlier"), "taken",
                F.when(F.col("left") < F.col("tokens"), F.col("left")).alias("left"),
            ).alias("turn"),
        )
    )
    of = lambda c: F.col(f"{turn}.{c}")
    mine = turns.select(F.col("s").alias(f"{s}2"), F.col("b").alias(f"{b}2"), F.col("turn").alias(turn))
    met = blocked.join(sized(mine), (F.col(s) == F.col(f"{s}2")) & (F.col(b) == F.col(f"{b}2")))
    met = met.withColumn(n, F.when(of("left").isNotNull(), size))  # only blocks that are cut need their documents' tokens
    within = Window.partitionBy(s, b, of("pass")).orderBy(F.xxhash64(F.lit(seed), h, of("pass")), h).rowsBetween(Window.unboundedPreceding, 0)
    rank, before = fresh("rank"), fresh("before")
    out = met.withColumn(rank, F.count("*").over(within)).withColumn(before, F.sum(n).over(within) - F.col(n)).where(of("left").isNull() | (F.col(before) < of("left")))
    position = of("first") + F.col(rank) - 1
    given = (of("pass").cast("int"), F.col(b).cast("long"), position.cast("long"), F.least((of("earlier") + position + 0.5) / of("taken"), F.lit(1.0)))
    return out.select(*[F.col(f"`{c}`") for c in kept], *[c.alias(name) for c, name in zip(given, names, strict=True)])
