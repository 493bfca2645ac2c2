"""Connected components of a graph given by its links, with DataFrame operations only.

Alternating stars: each node tells its larger neighbours (large star) and then its smaller ones
(small star) the smallest node it knows, until the links are stars around the smallest node of
each component. Hubs are met by partial aggregation and by joins that adaptive execution splits.
Every round is written, so a lost executor costs tasks of one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from shelfwise.llm.common import written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    to_least = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return to_least.unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b``); the root is the smallest node.

    Null ends and links of a node with itself are ignored.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    before, state = None, written(links.distinct(), "links")
    while True:
        seen = Observation()
        state = written(
            _small_star(_large_star(state).distinct())
            .distinct()
            .observe(
                seen,
                F.count(F.lit(1)).alias("n"),
                F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
            ),
            "stars",
        )
        now = (seen.get["n"], seen.get["h"])
        if now == before or not now[0]:
            break
        before = now
    stars = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
