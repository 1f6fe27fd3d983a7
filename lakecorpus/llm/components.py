"""Connected components of a table of links, by alternating large-star and small-star rounds.

Nothing but the counts of a round comes to the driver. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hangs the neighbours of each node that are larger (or, small star, not larger) on its least neighbour."""
    both = links.select("u", "v").union(links.select(F.col("v"), F.col("u"))) if large else links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # written, so that the join reads two plain exchanges and the engine can split a node with many neighbours
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, tag: str = "components") -> DataFrame:
    """(node, root) of every node of ``links`` (u, v); root is the least node of its component.

    Nulls and links of a node to itself are left out. Repeated links count once. No links give an empty result.
    """
    links = cut(links.select("u", "v").where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), tag)
    before = None
    while True:
        state = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if state == before:
            break
        before = state
        links = cut(_star(cut(_star(links, True), tag), False), tag)
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select("v", "v").distinct())
