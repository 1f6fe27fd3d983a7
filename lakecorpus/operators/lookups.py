"""Joins of rows with tables of names, ids and sidecar files.

Tables are joined, never collected into a dictionary: the planner broadcasts those that are small when they are measured.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of sidecar files, the better first (fixed values).
SIDECAR_ORDER = ("json", "txt")


def stem(path: Column) -> Column:
    """A file's path without its last suffix."""
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(?<=[^/])\.([^./]*)$", 1))


def with_sidecars(images: DataFrame, labels: DataFrame, order: tuple[str, ...] = SIDECAR_ORDER) -> DataFrame:
    """Images (path) with label_path and label of the sidecar (path, label) of the same stem; of several the best kind, then the least path. Images without one stay.

    Other kinds of files are no sidecars.
    """
    place = F.array_position(F.array(*map(F.lit, order)), suffix(F.col("path")))
    best = labels.select(stem(F.col("path")).alias("_stem"), F.struct(place.alias("place"), "path", "label").alias("s")).where(F.col("s.place") > 0)
    best = best.groupBy("_stem").agg(F.min_by("s", F.struct("s.place", "s.path")).alias("s"))
    return images.withColumn("_stem", stem(F.col("path"))).join(best, "_stem", "left").select(*images.columns, F.col("s.path").alias("label_path"), F.col("s.label").alias("label"))


def lookup(rows: DataFrame, table: DataFrame, key: str, value: str, default=None) -> DataFrame:
    """Rows with ``value`` of the table (key, value); ``default`` where it has no such key. Keys of the table are unique; null has no value."""
    out = rows.join(table.select(key, value), key, "left")
    return out if default is None else out.withColumn(value, F.coalesce(value, F.lit(default)))


def to_global(tokens: DataFrame, local: DataFrame, vocabulary: DataFrame, unknown: int) -> DataFrame:
    """Tokens (local_id) with global_id: by the surface that local vocabulary (token, local_id) and unified vocabulary (token, id) share.

    A surface that two tracks share has one id, wherever it lies; what the unified vocabulary lacks is ``unknown``.
    """
    mapped = local.join(vocabulary.select("token", F.col("id").alias("global_id")), "token").select("local_id", "global_id")
    return lookup(tokens, mapped, "local_id", "global_id", unknown)


def fixed_words(words: DataFrame, table: DataFrame) -> DataFrame:
    """Words with their fixed spelling from a table (word, spelling); others keep theirs."""
    return words.join(table, "word", "left").withColumn("spelling", F.coalesce("spelling", "word"))


def with_config(rows: DataFrame, configs: DataFrame, key: str = "bucket") -> DataFrame:
    """Rows with the columns of their bucket's configuration, and ``known``, whether there is one."""
    return rows.join(configs.withColumn("known", F.lit(True)), key, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def aligned(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of two tables that must have the same keys, side by side; a key that one lacks raises when it is read."""
    a, b = first.withColumn("_a", F.lit(True)), second.withColumn("_b", F.lit(True))
    complete = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    told = F.when(complete, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("only one side has "), F.col(key).cast("string"))).cast("boolean"))
    return a.join(b, key, "full").where(told).drop("_a", "_b")


def not_done(units: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Units whose key no earlier run has finished."""
    return units.join(done.select(key).distinct(), key, "left_anti")
