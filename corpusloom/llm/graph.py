"""Connected components of a links table, by alternating large and small stars; nothing but counters reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import written


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Large: each node hands its least neighbour to its larger neighbours. Small: each node joins its smaller neighbours to the least of them."""
    if large:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return both.join(least, "a").where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = links.groupBy("a").agg(F.min("b").alias("m"))  # links point from the larger to the smaller
    return links.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")))).alias("l")).select("l.*").where("a != b").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (the least node that links lead to) for every node with a link to another node."""
    now = written(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a != b").distinct(), "links")
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.col("b").cast("decimal(38,0)"))).first())
    seen = state(now)
    while seen[0]:
        now = written(_stars(_stars(now, True), False), "links")
        if (fresh := state(now)) == seen:
            break
        seen = fresh
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
