"""Aggregates of evidence, coverage and attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskloom.functions import values as V
from deskloom.functions.text import safe_code


def tier(urls: Column, publishers: Column, first_relationship: Column | None = None) -> Column:
    """Corroborated from two urls of two publishers; a lone url of an originating source; else insufficient."""
    lone = (urls == 1) & (publishers == 1)
    if first_relationship is not None:
        lone &= first_relationship == "originating"
    return F.when((urls >= 2) & (publishers >= 2), "corroborated").when(lone, "authoritative-single").otherwise("insufficient")


def evidence(items: DataFrame, group: str, url: str, publisher: str, relationship: str, order: str) -> DataFrame:
    """A01 per group over items that are not mere context: distinct urls and publishers, and the tier."""
    factual = F.coalesce(F.col(relationship), F.lit("")) != "context"
    out = items.groupBy(group).agg(
        F.count_distinct(F.when(factual, F.col(url))).alias("item_sources"),
        F.count_distinct(F.when(factual, F.col(publisher))).alias("publishers"),
        F.min_by(relationship, F.when(factual, F.col(order))).alias("first_relationship"),
    )
    return out.withColumn("tier", tier(F.col("item_sources"), F.col("publishers"), F.col("first_relationship")))


def coverage(results: DataFrame, desk: str, source: str, publisher: str, ok: str, least: int = 2) -> DataFrame:
    """A02 per desk: configured, ok and failed sources, distinct ok publishers, and whether they are enough."""
    good = F.col(ok)
    out = results.groupBy(desk).agg(
        F.count_distinct(source).alias("configured"),
        F.count_distinct(F.when(good, F.col(source))).alias("ok_sources"),
        F.count_distinct(F.when(~good, F.col(source))).alias("failed_sources"),
        F.count_distinct(F.when(good, F.col(publisher))).alias("ok_publishers"),
    )
    return out.withColumn("covered", F.col("ok_publishers") >= least)


def rejection_histogram(assessed: DataFrame, reasons: str, known: list[str] | None = None, other: str = "OTHER_REJECTION") -> DataFrame:
    """A03, or A04 with known codes: rows per reason code; a row may add to several."""
    code = F.explode(reasons).alias("code")
    out = assessed.select(code)
    if known is not None:
        out = out.select(safe_code(F.col("code"), known, other).alias("code"))
    return out.groupBy("code").agg(F.count("*").alias("n"))


def attempt_status(failed: Column, total: Column, selected: Column) -> Column:
    """The worst of what holds: no source at all, then a quiet edition, then failures."""
    return (
        F.when(failed == total, "ingestion-failure")
        .when((selected == 0) & (failed > 0), "degraded-quiet")
        .when(selected == 0, "quiet")
        .when(failed > 0, "degraded")
        .otherwise("healthy")
    )


def unobserved(sources: DataFrame, counts: list[str]) -> DataFrame:
    """Each source with zero for every count."""
    return sources.select("*", *[F.lit(0).cast("long").alias(c) for c in counts])


def severity(codes: DataFrame, group: str, level: str) -> DataFrame:
    """A11 per group: failed with any error, else warnings with any warning, else passed."""
    rank = F.max(F.when(F.col(level) == "error", 2).when(F.col(level) == "warning", 1).otherwise(0))
    return codes.groupBy(group).agg(F.element_at(F.array(F.lit("passed"), F.lit("warnings"), F.lit("failed")), rank + 1).alias("outcome"))


def common_elements(groups: DataFrame, group: str, elements: str) -> DataFrame:
    """The elements that all rows of a group share, sorted, and the smallest of them."""
    sizes = groups.groupBy(F.col(group).alias("g")).agg(F.count("*").alias("rows"))
    shared = (
        groups.select(group, F.explode(F.array_distinct(elements)).alias("e"))
        .groupBy(group, "e").agg(F.count("*").alias("n"))
        .join(sizes, F.col(group).eqNullSafe(F.col("g")) & (F.col("n") == F.col("rows")))
    )
    return shared.groupBy(group).agg(F.array_sort(F.collect_set("e")).alias("shared"), F.min("e").alias("key"))


def repeated(df: DataFrame, entity: Column) -> DataFrame:
    """Entities that occur more than once."""
    return df.groupBy(entity.alias("entity")).agg(F.count("*").alias("n")).where("n > 1")


KNOWN = V.KNOWN_REJECTIONS
