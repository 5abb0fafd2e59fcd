"""Connected components of a distributed link table, by alternating large and small stars.

Each round links every node's larger neighbours to its smallest one (large star), then its smaller neighbours and itself
to the smallest (small star); the links end as stars around each component's smallest node. Both stars are a minimum per
node, combined before the shuffle, and a join back, whose large side Spark can split when one node has very many links.
Each round is written to the shared folder, and the one before it deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskloom.checkpoints import Written

#: Joins go by a node id with some bits turned over, so that both sides are dealt out anew and a hot side can be split.
TURNED = 0x5BD1E995


def _turned(column: str):
    return F.col(column).bitwiseXOR(F.lit(TURNED)).alias("k")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node with a link to another, the smallest node that links lead to.

    Nodes that are their component's smallest are left out, as nodes without links are. Links with a null end and links
    of a node to itself count for nothing; repeated links count once.
    """
    edges = Written(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    before = None
    while True:
        now = edges.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now[0] == 0 or now == before:
            return edges.df.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
        both = edges.df.select("u", "v").unionByName(edges.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        near = low.select(_turned("u"), F.least("u", "m").alias("m"))
        large = edges.df.select("u", _turned("v")).join(near, "k").select("u", F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(_turned("u"), "m")
        small = large.select("u", "v", _turned("u")).join(low, "k")
        pairs = F.when(F.col("v") == F.col("m"), F.array(F.struct("u", F.col("m").alias("v")))).otherwise(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        after = Written(small.select(F.inline(pairs)).distinct())
        edges.remove()
        edges = after
