"""Connected components of an undirected graph given by its links, by alternating stars.

Large-star links every larger neighbour of a node to the smallest; small-star does so with the
smaller ones. Both are one aggregate and one join, in which a node of many links is not one
task's; they end in a star around each smallest node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import keyed_join, stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("__rows")), "stars-least")
    met = keyed_join(both, least, ["u"])
    out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node that it reaches) for every node with a link.

    links: u, v of one comparable type, in any order, repeated or not; a node linked with itself
    alone, and nulls, are passed over. Every round is written to the shared folder.
    """
    now = stored(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = None
    while True:
        now = stored(_star(stored(_star(now, True), "stars-large"), False), "stars")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
