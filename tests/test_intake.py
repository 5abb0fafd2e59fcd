"""X05 by keyed state: replays, second runs and forgotten keys."""

import time
from datetime import timedelta

import pytest

from deskloom.streaming import intake


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, before)


def run(spark, tmp_path, checkpoint, known=None, ttl=None):
    stream = spark.readStream.schema("k string, v int, note string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    kept = intake.first_writes_kept(stream, "k", "v", known, ttl)
    query = kept.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    return sorted(((r["k"] or "-", r["v"], r["note"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()))


def arrive(spark, tmp_path, rows):
    spark.createDataFrame(rows, "k string, v int, note string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def test_first_writes_kept(rocks, tmp_path):
    arrive(rocks, tmp_path, [("a", 2, "late"), ("a", 1, "x"), ("a", 1, "b"), ("b", 3, None), (None, 5, "n"), (None, 6, "n")])
    first = [("-", 5, "n"), ("a", 1, "b"), ("b", 3, None)]
    assert run(rocks, tmp_path, "one") == first
    assert run(rocks, tmp_path, "one") == first
    arrive(rocks, tmp_path, [("a", 0, "earlier, but not the first"), ("c", 4, "new"), (None, 1, "n")])
    assert run(rocks, tmp_path, "one") == [*first, ("c", 4, "new")]


def test_second_run_knows_the_target(rocks, tmp_path):
    arrive(rocks, tmp_path, [("a", 1, "x"), ("b", 3, "y")])
    first = run(rocks, tmp_path, "one")
    known = rocks.createDataFrame([("a",), ("b",), ("a",)], "k string")
    stream = rocks.readStream.schema("k string, v int, note string").parquet(str(tmp_path / "in"))
    arrive(rocks, tmp_path, [("d", 9, "z")])
    query = intake.first_writes_kept(stream, "k", "v", known).writeStream.format("memory").queryName("second").option("checkpointLocation", str(tmp_path / "two")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [tuple(r) for r in rocks.table("second").collect()] == [("d", 9, "z")] and len(first) == 2


def test_keys_are_forgotten(rocks, tmp_path):
    """Without batches that only serve timers, a run over what is there ends."""
    rocks.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    arrive(rocks, tmp_path, [("a", 1, "x")])
    run(rocks, tmp_path, "one", ttl=timedelta(seconds=1))
    time.sleep(2)
    arrive(rocks, tmp_path, [("a", 2, "again")])
    assert run(rocks, tmp_path, "one", ttl=timedelta(seconds=1)) == [("a", 1, "x"), ("a", 2, "again")]
    rocks.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
