"""Small files and folders in whatever store Spark writes to: existence, listings, and texts that appear whole or not at all."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    store, at = _at(spark, path)
    return store.exists(at)


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, sorted; none if it isn't there."""
    store, at = _at(spark, folder)
    return sorted(x.getPath().getName() for x in store.listStatus(at)) if store.exists(at) else []


def listing(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time) of all files that a path or pattern names, folders with all that is in them, sorted. Names that Spark's readers pass over don't count."""
    store, at = _at(spark, path)
    out = []
    for found in store.globStatus(at) or []:
        each = store.listFiles(found.getPath(), True)
        while each.hasNext():
            f = each.next()
            inside = f.getPath().toString().removeprefix(found.getPath().toString())
            if not any(p.startswith(("_", ".")) for p in inside.split("/")):
                out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def delete(spark: SparkSession, path: str) -> None:
    store, at = _at(spark, path)
    store.delete(at, True)


def read(spark: SparkSession, path: str, most: int = 1 << 16) -> bytes:
    """The first bytes of a file; only those are read."""
    store, at = _at(spark, path)
    stream = store.open(at)
    try:
        size = min(most, store.getFileStatus(at).getLen())
        return bytes(stream.readNBytes(int(size)))
    finally:
        stream.close()


def write_whole(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small text under another name first, then gives it its own: who looks finds all of it or nothing."""
    store, at = _at(spark, path)
    _, early = _at(spark, f"{path.rpartition('/')[0]}/_{path.rpartition('/')[2]}")
    stream = store.create(early, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    store.delete(at, False)
    if not store.rename(early, at):
        raise OSError(f"cannot rename to {path}")


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: that of checkpoints. Only on one machine a temporary one stands in where the session has none."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lakecorpus-")
    return at.rstrip("/")


class Rolling:
    """A table that each round of a loop writes anew: it survives lost executors, and the one of the round before goes."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at, self.path = spark, f"{shared(spark)}/{name}-{uuid.uuid4().hex}", None

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.at}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        if self.path:
            delete(self.spark, self.path)
        self.path = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        delete(self.spark, self.at)
