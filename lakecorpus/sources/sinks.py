"""Writers: JSON lines, shards of a size with a manifest, buckets, reports."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakecorpus.operators.training_rows import shard_ids


def write_jsonl(rows: DataFrame, path: str, append: bool = False, min_chars: int = 0, compression: str | None = None) -> None:
    kept = rows.where(F.length("text") >= min_chars) if min_chars else rows
    kept.write.mode("append" if append else "overwrite").json(path, compression=compression)


def write_lines(rows: DataFrame, path: str, column: str = "text") -> None:
    """Plain text, a row a line: line ends inside a text become spaces."""
    rows.select(F.regexp_replace(column, r"[\r\n]+", " ").alias("value")).write.mode("overwrite").text(path)


def write_status(spark, path: str, **facts) -> None:
    """One JSON line about a run, written over the one before; numbers that JSON can't hold become null."""
    safe = {k: None if isinstance(v, float) and not math.isfinite(v) else v for k, v in facts.items()}
    line = json.dumps(safe, ensure_ascii=False, default=str, sort_keys=True)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_predictions(rows: DataFrame, path: str, columns: tuple[str, ...] = ("image", "ref", "pred")) -> None:
    rows.select(*columns).write.mode("overwrite").json(path)


def write_buckets(rows: DataFrame, path: str, *keys: str) -> None:
    rows.write.mode("overwrite").partitionBy(*keys).json(path, compression="gzip")


def write_shards(rows: DataFrame, path: str, size, budget: int, position: str = "doc_id", groups: int = 64) -> DataFrame:
    """Writes JSON lines in folders shard=N of at most ``budget`` in size each, and returns the manifest.

    Rows are dealt to ``groups`` by a hash of their position and fill shards in order within a group; a row over the budget has a shard to itself.
    """
    group = F.pmod(F.xxhash64(position), F.lit(groups)).cast("long")
    sizes = rows.select(group.alias("grp"), F.col(position).alias("position"), size.alias("size"))
    at = shard_ids(sizes, budget).select(F.col("position").alias(position), (F.col("shard") * groups + F.col("grp")).alias("shard"))
    rows.join(at, position).repartition("shard").sortWithinPartitions("shard", position).write.mode("overwrite").partitionBy("shard").json(path, compression="gzip")
    return manifest(rows.sparkSession, path)


def manifest(spark, path: str) -> DataFrame:
    """(path, bytes, sha256) of each written file, hashed on the executors."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path)
    return found.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def report(counts: DataFrame) -> str:
    """A small table of counts as JSON text, for a report file of the driver."""
    return json.dumps([r.asDict(recursive=True) for r in counts.collect()], ensure_ascii=False, indent=1, default=str)


def dataset_card(name: str, counts: DataFrame, key: str, value: str) -> str:
    """A Markdown card with a table of counts."""
    rows = "\n".join(f"| {r[key]} | {r[value]} |" for r in counts.orderBy(key).collect())
    return f"# {name}\n\n| {key} | {value} |\n|-|-|\n{rows}\n"
