"""Connected components of an edge table by alternating star contractions.

Every round is two grouped minima with map-side combination and two equi-joins, so a hub with
many neighbours is pre-aggregated before its shuffle and the join back is splittable by AQE.
Lineage is cut by a scratch table after each round; only two numbers per round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _sign(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b").cast("decimal(38,0)")
    row = edges.agg(F.count("*").alias("n"), F.sum(h).alias("s")).first()
    return row["n"], row["s"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
    return moved.union(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the edges that isn't its component's smallest one.

    Self-loops, repeated edges and either direction are allowed; null ends are dropped; an empty
    table gives an empty one.
    """
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    now = written(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sign = _sign(now)
    while sign[0]:
        now = written(_small_star(_large_star(now)), "edges")
        before, sign = sign, _sign(now)
        if before == sign:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
