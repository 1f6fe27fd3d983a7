"""Corpora of several files with a layout: which files belong to it, of what kind they are, and what in them is text; files that can't be read are told apart."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakecorpus.operators.dedup import checkpointed

from . import readers, store

EMPTY = "path string, pos long, text string"


@dataclass(frozen=True)
class Part:
    """Files of a layout: a pattern below its root, how they are read (``fields``: JSON of either layout, ``array``, ``lines``), and the fields that are texts."""

    pattern: str
    kind: str
    fields: tuple[str, ...] = ()


#: The Chinese bundle (fixed values).
CHINESE_BUNDLE = (
    Part("人民日报2023.json", "fields", ("content", "title")),
    Part("问答语料300.json", "fields", ("question", "answer")),
    Part("JournalArticle2013_2023/*.json", "array", ("remark_c", "title_c", "keyword_c", "remark_e", "title_e", "keyword_e")),
    Part("TsinghuaBilingualCorpus/*.txt", "lines"),
)


def _placed(rows: DataFrame) -> DataFrame:
    pos = F.col("pos") if "pos" in rows.columns else F.monotonically_increasing_id()
    return rows.select("path", pos.cast("long").alias("pos"), "text")


def read_layout(spark: SparkSession, root: str, parts: tuple[Part, ...] = CHINESE_BUNDLE) -> DataFrame:
    """(part, path, pos, text) of all parts of a layout that are there; one that isn't has no rows."""
    out = spark.createDataFrame([], f"part int, {EMPTY}")
    for k, p in enumerate(parts):
        at = f"{root.rstrip('/')}/{p.pattern}"
        if not store.listing(spark, at):
            continue
        if p.kind == "lines":
            rows = readers.read_lines(spark, at)
        elif p.kind == "array":
            rows = readers.read_json_array(spark, at, p.fields)
        elif p.kind == "fields":
            rows = readers.read_json_fields(spark, at, p.fields)
        else:
            raise ValueError(f"unknown kind {p.kind!r}")
        out = out.unionByName(_placed(rows).withColumn("part", F.lit(k)))
    return out


def parquet_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, n_rows, columns, error) of Parquet files, from their footers alone; error is null for those that can be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    with pa.BufferReader(content) if content is not None else readers._open(path) as f:
                        footer = pq.ParquetFile(f)
                        out.append((path, footer.metadata.num_rows, footer.schema_arrow.names, None))
                except (pa.ArrowException, OSError, ValueError) as e:
                    out.append((path, None, None, f"{type(e).__name__}: {str(e)[:200]}"))
            columns = list(zip(*out, strict=True)) or [()] * 4
            types = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=["path", "n_rows", "columns", "error"])

    found = readers._archives(spark, path, "*.parquet")
    return found.mapInArrow(run, "path string, n_rows long, columns array<string>, error string")


def read_parquet_files(spark: SparkSession, path: str | list[str], keys: tuple[str, ...] = ("text",), need: bool = True) -> tuple[DataFrame, DataFrame]:
    """(path, pos, text) of all files that can be read, and (path, error) of those that can't: broken ones and, unless they are needed, those without any of the key columns.

    Files may have different key columns; in each row the first that isn't empty is the text. With ``need`` a file without any of them raises, and so do no files at all.
    """
    files = checkpointed(parquet_files(spark, path).withColumn("there", F.array_intersect("columns", F.array(*map(F.lit, keys)))))
    lacks = files.where(F.col("error").isNull() & (F.size("there") == 0))
    if need and (files.isEmpty() or not lacks.isEmpty()):
        first = lacks.select("path", "columns").first()
        raise ValueError(f"none of the columns {keys} in {first.path}: {first.columns}" if first else f"no Parquet files under {path}")
    bad = files.where(F.col("error").isNotNull()).select("path", "error").union(lacks.select("path", F.lit("no text column").alias("error")))
    out = spark.createDataFrame([], EMPTY)
    # files of one set of columns are read together; there are few such sets
    for there in sorted(tuple(r.there) for r in files.where(F.col("error").isNull() & (F.size("there") > 0)).select("there").distinct().collect()):
        names = [r.path for r in files.where(F.col("error").isNull() & (F.col("there") == F.array(*map(F.lit, there)))).select("path").collect()]  # names of files
        out = out.unionByName(_placed(readers.read_parquet_text(spark, names, tuple(k for k in keys if k in there))))
    return out, bad
