"""Means of vectors over segments: sums and counts of each element, merged like any other aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clamped(segment: Column, most: int) -> Column:
    """A segment number in [0, most): what lies outside belongs to the first or last."""
    return F.least(F.greatest(segment, F.lit(0)), F.lit(most - 1))


def mean_pool(rows: DataFrame, *keys: str, vector: str = "vector", mask: str | None = None) -> DataFrame:
    """(keys, n, vector): the mean of the vectors of each group, element by element, of those whose mask is true.

    A group without any has zeros; null vectors don't count, nor do null elements, which a mean has a zero for. Vectors of a group may differ in length: a mean is as long as the longest. Each task adds up its rows first, so a group
    that holds most of the rows is a few rows a task; null keys group like others.
    """
    if not keys:
        raise ValueError("a mean is one of groups")
    used = F.coalesce(F.col(mask), F.lit(False)) if mask else F.lit(True)
    none = F.array().cast("array<double>")
    # a one in front of each vector counts it
    counted = F.concat(F.array(F.when(F.col(vector).isNotNull(), 1.0)), F.coalesce(F.col(vector).cast("array<double>"), none))
    each = rows.select(*keys, used.alias("_used"), F.posexplode(counted).alias("_k", "_x"))
    sums = each.groupBy(*keys, "_k").agg(F.coalesce(F.sum(F.when(F.col("_used"), F.col("_x"))), F.lit(0.0)).alias("_sum"))
    # a row for each element of a group's vector
    groups = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_k", "_sum"))).alias("_sums"))
    n = F.get("_sums", F.lit(0))["_sum"]
    return groups.select(*keys, n.cast("long").alias("n"), F.transform(F.slice("_sums", F.lit(2), F.size("_sums")), lambda s: s["_sum"] / F.greatest(n, F.lit(1.0))).alias(vector))


def scatter_back(rows: DataFrame, pooled: DataFrame, *keys: str, vector: str = "vector") -> DataFrame:
    """Gives each row the mean of its group, as ``pooled``; null where it has none."""
    means = pooled.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(vector).alias("pooled"))
    return rows.join(means, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*[f"_{k}" for k in keys])
