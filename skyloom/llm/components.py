"""Connected components by alternating large-star and small-star steps, each a group-by and a join of the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skyloom.sources.staging import written


def _down(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger end to the smaller; loops go."""
    return edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(down: DataFrame) -> DataFrame:
    both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(down: DataFrame) -> DataFrame:
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    return _down(down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.toDF("u", "v")))


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) -> (u, root) for every node but the roots, root being the smallest node of u's component."""
    now = written(_down(edges), "edges")
    while True:
        done = now.join(now.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() and now.groupBy("u").count().filter("count > 1").isEmpty()
        if done:
            return now.withColumnRenamed("v", "root")
        now = written(_small_star(_large_star(now)), "edges")
