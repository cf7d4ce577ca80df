"""Connected components of links by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import written


def _round(links: DataFrame, large: bool) -> DataFrame:
    """Each node passes its least neighbour to its greater (large star) or other smaller (small star) neighbours."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        told = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        told = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.withColumnRenamed("m", "b"))
    return told.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Links (a, b) -> (node, component): every linked node and the least node that it is connected to.

    Null ends and loops are left out. Every round is written to shared storage, so a lost executor costs one round;
    the number of rounds grows with the logarithm of the longest chain. The links are never collected.
    """
    now = written(links.select("a", "b").dropna().where(F.col("a") != F.col("b")).distinct(), "links")
    mark = None
    for _ in range(rounds):
        now = written(_round(_round(now, True), False), "stars")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(new) == mark:
            break
        mark = tuple(new)
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    own = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(own)
