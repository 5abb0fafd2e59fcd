"""The registry of queries: each takes (spark, sf_dir); those that SQL can express carry the DuckDB SQL that they equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function by its name."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver. Times without a zone are read as instants (of UTC), so filters on them reach the scan."""
    path = f"{sf_dir}/{name}.parquet"
    found = spark.read.parquet(path)
    if "timestamp_ntz" not in (kinds := dict(found.dtypes)).values():
        return found
    schema = ", ".join(f"`{c}` {'timestamp' if k == 'timestamp_ntz' else k}" for c, k in kinds.items())
    return spark.read.schema(schema).parquet(path)


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt out by a key: a small file is one task, however much is then done for each of its rows."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, key)
