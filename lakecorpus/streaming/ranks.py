"""Rows of files for the ranks and workers of a training run: dealt, ordered anew in each epoch, resumed in the middle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakecorpus.functions.hashing import uniform


def deal_files(files: DataFrame, ranks: int, workers: int = 1) -> DataFrame:
    """(path, rank, worker) of files (path): in order of path to ranks in turn, and each rank's to its workers in turn.

    Where there are fewer files than ranks, each rank has all of them, so none stands idle. Files are thousands at most, rows are not touched.
    """
    if ranks < 1 or workers < 1:
        raise ValueError("there must be a rank and a worker")
    names = files.select("path").distinct()
    n = names.agg(F.count(F.lit(1)).alias("_n"))
    placed = names.withColumn("_i", F.row_number().over(Window.orderBy("path")) - 1).crossJoin(n)  # one row of counts
    all_ranks = F.sequence(F.lit(0), F.lit(ranks - 1))
    few = F.col("_n") < ranks
    of = placed.withColumn("rank", F.explode(F.when(few, all_ranks).otherwise(F.array(F.pmod("_i", F.lit(ranks))))))
    at = F.when(few, F.col("_i")).otherwise(F.floor(F.col("_i") / ranks))
    return of.select("path", F.col("rank").cast("int").alias("rank"), F.pmod(at, F.lit(workers)).cast("int").alias("worker"))


def epochs(rows: DataFrame, n: int, seed: int = 0, position: str = "doc_id") -> DataFrame:
    """Each row ``n`` times, with epoch and draw: a number in [0, 1) that follows from seed, rank, epoch and position and orders the epoch.

    Every row comes once before any comes again. No rows raise when they are read.
    """
    counted = rows.agg(F.count(F.lit(1)).alias("_n"))
    some = counted.select(F.when(F.col("_n") > 0, F.lit(True)).otherwise(F.raise_error(F.lit("there are no rows")).cast("boolean")).alias("_some"))
    each = rows.crossJoin(some).where("_some").drop("_some").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    rank = F.col("rank").cast("string") if "rank" in rows.columns else F.lit("0")
    return each.withColumn("draw", uniform(F.concat_ws("|", F.lit(str(seed)), rank, F.col("epoch").cast("string")), F.col(position).cast("string")))


def batches(drawn: DataFrame, size: int, keys: tuple[str, ...] = (), position: str = "doc_id") -> DataFrame:
    """Adds batch: the number of each row's batch of ``size`` in the order of epoch and draw, counted for each of the keys.

    A window over a rank's rows: keys such as rank and worker keep it to what one of them reads.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("epoch", "draw", position)) - 1
    return drawn.withColumn("batch", F.floor(place / size).cast("long"))


def resume(batched: DataFrame, step: int, accumulated: int = 1) -> DataFrame:
    """What is left after ``step`` steps of ``accumulated`` batches each."""
    return batched.where(F.col("batch") >= max(0, step) * accumulated)
