"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that end a word: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
#: Stands for a null group key, so that null keys group and join like any other value.
NULL_KEY = "\x00null"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none and runs on one machine (tests) a temporary folder stands in for it; a cluster must name one.
    """
    global _own_dir
    at = spark.conf.get("spark.checkpoint.dir", None) or _own_dir
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = _own_dir = "file://" + tempfile.mkdtemp(prefix="lakecorpus-")
    return at.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/lakecorpus/{tag}-{uuid.uuid4().hex}"


#: Paths of the tables that ``cut`` made and nobody dropped, in order.
_cuts: list[str] = []


def cut(df: DataFrame, tag: str, listed: bool = True) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back.

    Cuts the lineage with a table that survives lost executors. The schema is
    given to the reader, so an empty table reads back as well. ``listed`` tables go with ``drop_cuts``.
    """
    spark = df.sparkSession
    path = shared_path(spark, tag)
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")  # shuffle files go once the table is written
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(clean, before)
    if listed:
        _cuts.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_cut(df: DataFrame) -> None:
    """Deletes the files of a table that ``cut`` made, once nothing reads it any more."""
    for at in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/lakecorpus/" in at:
            _delete(df.sparkSession, at)


def listed(path: str) -> str:
    """A folder in the shared one that goes with ``drop_cuts``, too."""
    _cuts.append(path)
    return path


def drop_cuts(spark: SparkSession) -> None:
    """Deletes all listed tables: for use between jobs, when the results that were read from them are written."""
    while _cuts:
        _delete(spark, _cuts.pop())


def all_columns(df: DataFrame) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def row(df: DataFrame) -> Column:
    """The whole row as one column ``_row``: carried along so, no name of it can clash with an operator's own. ``_row.*`` takes it apart."""
    return F.struct(*all_columns(df)).alias("_row")


def group_key(column: str) -> Column:
    """A column as a group key that is never null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(NULL_KEY))


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
