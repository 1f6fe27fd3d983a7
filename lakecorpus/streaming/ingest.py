"""Incremental ingest with Structured Streaming: new files are cleaned once, and what was seen before is dropped.

The checkpoint holds which files were read, so a restart goes on where it stopped; the state of deduplication is a table of keys
and signatures that each batch reads and adds to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from lakecorpus.functions import hashing as H
from lakecorpus.operators import dedup
from lakecorpus.operators.quality import QualityConfig, quality_reason


def read_stream(spark: SparkSession, path: str, schema: StructType | str, file_format: str = "json", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.format(file_format).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def distinct_stream(docs: DataFrame) -> DataFrame:
    """A stream without documents whose squashed text came before, by the state store alone; its state grows with the keys."""
    return docs.withColumn("exact_key", H.exact_key(F.col("text"))).dropDuplicates(["exact_key"])


def normalized_stream(lines: DataFrame, normalize) -> DataFrame:
    """A stream of lines through a normalizer; empty lines go."""
    return lines.select(normalize(F.col("value")).alias("value")).where(F.col("value") != "")


def clean_stream(docs: DataFrame, out: str, state: str, checkpoint: str, config: QualityConfig = QualityConfig(), near: bool = True, threshold: int = 3, min_terms: int = 120, position: str = "doc_id") -> StreamingQuery:
    """Writes accepted documents to ``out`` and their (exact_key, sig) to ``state``, until the input is read.

    A batch that is run again after a failure replaces its own files, and reads the state of the batches before it only.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        # judged once: both kinds of deduplication read their documents more than once
        passed = dedup.checkpointed(df.where(quality_reason(F.col("text"), config) == ""))
        if near:
            fresh = dedup.near_dedup(passed, threshold, min_terms, position)
        else:
            fresh = dedup.exact_dedup(passed, position).withColumn("sig", F.lit(None).cast("long"))
        old = "exact_key string, sig long, batch long"
        seen = spark.read.schema(old).parquet(state).where(F.col("batch") < number)
        new = dedup.checkpointed(dedup.dedup_against(fresh, seen, threshold))
        mode = new.withColumn("batch", F.lit(number).cast("long"))
        for path, columns in ((out, [c for c in new.columns if c not in ("exact_key", "sig")]), (state, ["exact_key", "sig"])):
            mode.select(*columns, "batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    spark = docs.sparkSession
    spark.createDataFrame([], "exact_key string, sig long, batch long").write.mode("append").partitionBy("batch").parquet(state)
    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def history(rows: DataFrame, n: int, keys: tuple[str, ...], time: str, tie: str) -> DataFrame:
    """The newest n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(time), F.desc(tie))
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
