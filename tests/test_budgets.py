"""S07 and W10 against sequential versions."""

import json
import random

from pyspark.sql import functions as F

from deskloom.operators import ranking


def sequential(rows, total, each):
    """One source after the other, as a single worker takes them."""
    consumed, out = 0, {}
    for i, octets, failed in rows:
        left = total - consumed
        if left < 1_024:
            out[i] = ("TOTAL_BODY_LIMIT", 0)
            continue
        reservation = min(each, left)
        bad = failed or failed is None or octets is None
        charge = reservation if bad or octets > reservation else octets
        out[i] = ("FAILED" if bad else "BODY_TOO_LARGE" if octets > reservation else "ok", charge)
        consumed += charge
    return out


def test_reserved_bytes(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([rng.randrange(4_000), None, 0]), rng.choice([False, False, True, None])) for i in range(100_000)]
    df = spark.createDataFrame(rows, "i long, octets long, failed boolean").repartition(7)
    for total in (10**9, 100_000_000, 5_000, 1_024, 0):
        got = {r["i"]: (r["outcome"], r["charge"]) for r in ranking.reserved_bytes(df, ["i"], "octets", "failed", total, 3_000).collect()}
        assert got == sequential(rows, total, 3_000)
    assert ranking.reserved_bytes(df.limit(0), ["i"], "octets", "failed", 9, 9).count() == 0


def test_prefix_sums_leave_no_task_with_all_rows(spark):
    df = spark.range(100_000).select("id", F.lit(1).alias("v")).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ranking.prefix_sums(df, ["id"], "v")
        assert out.where("prefix <> id").count() == 0
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert len(sizes) > 1 and max(sizes) < 60_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_slate(spark):
    rng = random.Random(5)
    for _ in range(4):
        rows = [(f"c{i}", rng.choice(["a", "b", "c", "other"]), rng.randrange(50), "x" * rng.randrange(400)) for i in range(40)]
        want, held = [], []
        for rank in range(2):
            for desk in ("b", "a", "c"):
                own = sorted((r for r in rows if r[1] == desk), key=lambda r: (-r[2], r[0]))
                if rank < len(own) and len(json.dumps([*held, own[rank][3]], separators=(",", ":"))) <= 900:
                    held.append(own[rank][3])
                    want.append((own[rank][0], desk, rank + 1, len(json.dumps(held, separators=(",", ":")))))
        df = spark.createDataFrame([(k, d, s, len(x) + 2) for k, d, s, x in rows], "k string, d string, s int, n int")
        got = ranking.slate(df, "d", [F.desc("s"), F.asc("k")], "k", "n", ["b", "a", "c"], budget=900)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
