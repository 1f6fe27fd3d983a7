"""Texts of one source, whatever its layout, as normalized JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakecorpus.functions import textnorm as N
from lakecorpus.operators.dedup import checkpointed
from lakecorpus.sources import layouts, readers, sinks, store

SOURCES = ("documents", "bundle", "wiki", "parquet", "jsonl")


def source_texts(spark: SparkSession, source: str, path: str, lang: str | None = None, date: str = "20231101", column: str = "text") -> tuple[DataFrame, DataFrame | None]:
    """(path, pos, text) of a source, and the files that couldn't be read if the source can tell.

    documents: text files below a folder, each a document; bundle: a layout of several files; wiki: Parquet files of ``date.lang`` below a folder, or of the folder itself; parquet and jsonl: a column of all files.
    """
    if source == "documents":
        return readers.read_documents(spark, path, "*.[tT][xX][tT]"), None
    if source == "bundle":
        rows = layouts.read_layout(spark, path)
        return rows.select(F.concat(F.format_string("%04d ", "part"), "path").alias("path"), "pos", "text"), None
    if source == "wiki":
        if not lang:
            raise ValueError("a wiki has a language")
        inner = f"{path.rstrip('/')}/{date}.{lang}"
        return layouts.read_parquet_files(spark, inner if store.exists(spark, inner) else path)
    if source == "parquet":
        return layouts.read_parquet_files(spark, path, (column,))
    if source == "jsonl":
        rows = readers.read_jsonl(spark, path, (column,), mark_bad=True).withColumn("pos", F.monotonically_increasing_id())
        bad = rows.where("bad").groupBy("path").agg(F.concat(F.count(F.lit(1)), F.lit(" broken lines")).alias("error"))
        return rows.where("NOT bad").select("path", "pos", "text"), bad
    raise ValueError(f"unknown source {source!r}; there are {SOURCES}")


def prepare_corpus(spark: SparkSession, source: str, path: str, out: str, lang: str | None = None, date: str = "20231101", column: str = "text", limit: int | None = None, min_chars: int = 1, append: bool = False) -> DataFrame:
    """Writes the texts of a source, each on one line, as JSON lines, and reports (path, written, error): texts written of each file, or why it has none.

    Texts are brought to canonical form; those that are nullish or under ``min_chars`` are left out. ``limit`` takes the first texts in the order of files and places.
    """
    rows, bad = source_texts(spark, source, path, lang, date, column)
    clean = rows.withColumn("text", N.normalize_line(F.col("text"))).where(F.length("text") >= max(min_chars, 1))
    clean = checkpointed(clean.orderBy("path", "pos").limit(limit) if limit else clean)
    sinks.write_jsonl(clean.select("text"), out, append=append)
    report = clean.groupBy("path").agg(F.count(F.lit(1)).alias("written")).withColumn("error", F.lit(None).cast("string"))
    return report if bad is None else report.unionByName(bad.select("path", F.lit(0).cast("long").alias("written"), "error"))
