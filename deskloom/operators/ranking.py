"""Window filters, rankings, fair samples and capped selections."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskloom.checkpoints import checkpointed


def in_window(df: DataFrame, instant: str, start, end) -> DataFrame:
    """Rows with start <= instant < end; nulls are outside."""
    return df.where((F.col(instant) >= start) & (F.col(instant) < end))


def top_k(df: DataFrame, group: str | list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group in the order, with their rank."""
    keys = [group] if isinstance(group, str) else group
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def fair_sample(df: DataFrame, source: str, order: list[Column], n: int) -> DataFrame:
    """Round by round the next row of every source; the last round keeps the first rows in the overall order."""
    turn = F.row_number().over(Window.partitionBy(source).orderBy(*order))
    return df.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", *order).limit(n)


def fair_allocation(df: DataFrame, desk: str, publisher: str, order: list[Column], per_publisher: int, total: int) -> DataFrame:
    """At most so many rows of a publisher in a desk, then desks in turn until the total is reached."""
    own = F.row_number().over(Window.partitionBy(desk, publisher).orderBy(*order))
    kept = df.withColumn("of_publisher", own).where(F.col("of_publisher") <= per_publisher)
    turn = F.row_number().over(Window.partitionBy(desk).orderBy(*order))
    return kept.withColumn("turn", turn).where(F.col("turn") <= total).orderBy("turn", desk, *order).limit(total)


def shortlist(df: DataFrame, desk: str, publisher: str, url: str, order: list[Column], per_desk: int, per_publisher: int, total: int) -> DataFrame:
    """A url stays in its first desk; then caps per publisher, per desk and overall."""
    lone = df.withColumn("at", F.row_number().over(Window.partitionBy(url).orderBy(desk, *order))).where("at = 1").drop("at")
    lone = lone.withColumn("of_publisher", F.row_number().over(Window.partitionBy(desk, publisher).orderBy(*order))).where(F.col("of_publisher") <= per_publisher)
    lone = lone.withColumn("turn", F.row_number().over(Window.partitionBy(desk).orderBy(*order))).where(F.col("turn") <= per_desk)
    return lone.orderBy("turn", desk, *order).limit(total)


def gaps(df: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """For each row whether it starts where the one before it in its group ended; null for the first."""
    before = F.lag(end).over(Window.partitionBy(group).orderBy(start, end))
    return df.withColumn("contiguous", F.col(start) == before)


# What the smallest admitted response needs, and the bytes of a slate's dossiers as a JSON array.
LEAST_BYTES, SLATE_BYTES = 1_024, 52_000


def prefix_sums(df: DataFrame, order: list[str], value: str, out: str = "prefix") -> DataFrame:
    """df with the sum of a column over all rows before each in a total order, with no task for all rows.

    Rows are dealt out in ranges of the order and written once; a range's own sums are windows within it, and the totals of the
    ranges, one row each, are added up and joined to their rows. Ranges must be of a total order: ties may go either way.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id())
    held = checkpointed(ranged)
    totals = held.groupBy("__range").agg(F.sum(value).alias("__sum"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = totals.select("__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return held.withColumn(out, own).join(F.broadcast(offsets), "__range").withColumn(out, F.col(out) + F.col("__offset")).drop("__range", "__offset")


def reserved_bytes(df: DataFrame, order: list[str], octets: str, failed: str, total: int, each: int) -> DataFrame:
    """Df with outcome, charge and consumed (the bytes before a source), for sources that share a budget in order.

    A source reserves `each` bytes or what is left of the total. One that succeeds within its reservation is charged its bytes;
    one that fails, or sends more, is charged the whole reservation. With less than LEAST_BYTES left, no source is begun any more.
    As every charge is min(bytes or each, what is left), the bytes before a source are the sum of those before it, bounded by the
    total: a sum over the order, which needs no task for all sources. A null number of bytes is a failure; so is a null flag.
    """
    fails = F.coalesce(F.col(failed), F.lit(True)) | F.col(octets).isNull() | (F.col(octets) > each)
    summed = prefix_sums(df.withColumn("__charge", F.when(fails, F.lit(each)).otherwise(F.col(octets)).cast("long")), order, "__charge", "__before")
    left = F.lit(total) - F.least(F.col("__before"), F.lit(total))
    begun = left >= LEAST_BYTES
    outcome = (
        F.when(~begun, "TOTAL_BODY_LIMIT").when(F.coalesce(F.col(failed), F.lit(True)) | F.col(octets).isNull(), "FAILED")
        .when(F.col(octets) > F.least(F.lit(each), left), "BODY_TOO_LARGE").otherwise("ok")
    )
    begun_before = F.col("__before") <= total - LEAST_BYTES
    return summed.select(
        *df.columns, outcome.alias("outcome"), F.when(begun, F.least(F.col("__charge"), left)).otherwise(0).cast("long").alias("charge"),
        F.when(begun_before, F.col("__before")).alias("consumed"),
    )


def slate(df: DataFrame, desk: str, order: list[Column], key: str, octets: str, desks: list[str], budget: int = SLATE_BYTES, ranks: int = 2) -> DataFrame:
    """(key, desk, rank, running): each desk's best, then each desk's second, in the order of desks; one that does not fit is
    skipped. octets are those of a candidate's JSON; running are the bytes of the array so far, with its brackets and commas.

    Ranks are found desk by desk; only ranks times desks rows are left for the selection. Rows of other desks take no part.
    """
    place = F.array_position(F.array(*[F.lit(d) for d in desks]), F.col(desk))
    best = top_k(df.where(F.col(desk).isin(desks)), desk, order, ranks)
    first = best.withColumn("rank", F.row_number().over(Window.partitionBy(desk).orderBy(*order))).withColumn("__at", F.col("rank") * 1_000 + place)
    chosen = skip_fit(first.select(key, desk, "rank", "__at", F.lit(1).alias("__all"), (F.col(octets) + 1).alias("__size")), "__all", ["__at"], "__size", budget - 1, key)
    return chosen.join(first.select(key, desk, "rank"), key).select(key, desk, "rank", (F.col("running") + 1).cast("long").alias("running"))


def skip_fit(df: DataFrame, group: str, order: list[str], size: str, budget: float, key: str) -> DataFrame:
    """Greedy selection in order that skips what does not fit; returns (group, key, running).

    Rows of a group come sorted and are streamed, so a group may be of any size.
    """
    kind = dict(df.dtypes)
    rows = df.select(group, key, F.col(size).cast("double").alias("__size"), *[F.col(o) for o in order if o not in (group, key)])
    rows = rows.repartition(group).sortWithinPartitions(group, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used = object(), 0.0
        for batch in batches:
            out = []
            for g, k, s in zip(batch[group], batch[key], batch["__size"], strict=True):
                if g != now:
                    now, used = g, 0.0
                if used + s <= budget:
                    used += s
                    out.append((g, k, used))
            yield pd.DataFrame(out, columns=[group, key, "running"])

    return rows.mapInPandas(run, f"`{group}` {kind[group]}, `{key}` {kind[key]}, running double")


def choose_best(attempts: DataFrame, group: str, attempt: str, selected: str) -> DataFrame:
    """The first attempt unless a later one selected strictly more, and what a retry changed."""
    out = attempts.groupBy(group).agg(
        F.max_by(attempt, F.struct(F.col(selected), -F.col(attempt))).alias("chosen"),
        F.count("*").alias("attempts"),
        F.max(selected).alias("selected"),
        F.min_by(selected, attempt).alias("first_selected"),
    )
    label = F.when(F.col("attempts") == 1, "not-needed").when(F.col("selected") > F.col("first_selected"), "improved").otherwise("no-improvement")
    return out.select(group, "chosen", "selected", label.alias("retry"))


def assignment(short: DataFrame, desk: str, desks: list, key: str, entity: str, score: str, adjacent: str, most_adjacent: int = 2) -> DataFrame:
    """One candidate or none for each desk: distinct entities, few adjacent; most desks filled, then score, then keys.

    short has at most ten rows for each of a few desks, so all combinations are few; entities that repeat are dropped as
    soon as a desk is added.
    """
    state = None
    for i, d in enumerate(desks):
        own = short.where(F.col(desk) == d).select(
            F.col(key).cast("string").alias(f"k{i}"), F.col(entity).cast("string").alias(f"e{i}"), F.col(score).cast("double").alias(f"s{i}"), F.col(adjacent).cast("int").alias(f"a{i}")
        )
        none = own.sparkSession.range(1).select(F.lit("~").alias(f"k{i}"), F.lit(None).cast("string").alias(f"e{i}"), F.lit(0.0).alias(f"s{i}"), F.lit(0).alias(f"a{i}"))
        own = own.unionByName(none)
        if state is None:
            state = own
            continue
        state = state.crossJoin(F.broadcast(own))
        for j in range(i):
            state = state.where(F.col(f"e{i}").isNull() | F.col(f"e{j}").isNull() | (F.col(f"e{i}") != F.col(f"e{j}")))
    n = len(desks)
    total = lambda c: sum((F.col(f"{c}{i}") for i in range(1, n)), F.col(f"{c}0"))
    filled = sum(((F.col(f"k{i}") != "~").cast("int") for i in range(1, n)), (F.col("k0") != "~").cast("int"))
    best = state.where(total("a") <= most_adjacent).select(*[F.col(f"k{i}").alias(f"desk_{i}") for i in range(n)], filled.alias("filled"), total("s").alias("score"))
    return best.orderBy(F.desc("filled"), F.desc("score"), *[f"desk_{i}" for i in range(n)]).limit(1)
