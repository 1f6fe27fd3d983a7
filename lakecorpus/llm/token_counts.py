"""Token counts of documents in flat, unindexed token files, by a separator scan.

A token file is nothing but little-endian ids, each document's followed by the end-of-document id. A scan cuts
files into blocks of equal size, whatever documents lie in them, searches each block for separators in one
vectorised pass, and stitches documents that span blocks with a prefix scan over the blocks' summaries.
"""

from __future__ import annotations

import base64
import functools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, listed, shared_path

#: Splits text before the merges, as the rank files of byte-level vocabularies have it (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class TokenFileConfig:
    #: File of ranks; it must be there on every executor.
    ranks: str
    #: The end-of-document id: a free one of the vocabulary.
    end: int = 50256
    #: Bytes of an id.
    width: int = 2
    #: Bytes of a block; a multiple of the width.
    block: int = 1 << 22

    @property
    def dtype(self) -> str:
        return f"<u{self.width}"


@functools.lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_token_files(docs: DataFrame, config: TokenFileConfig) -> DataFrame:
    """Writes each task's documents to one flat file in the shared folder; (path, ordinal, doc_id) of each.

    A retried task writes another file; only the files in the returned table, which is written by the tasks that succeeded, belong to it.
    Null texts are documents without tokens. The folder goes with ``drop_cuts``.
    """
    at = listed(shared_path(docs.sparkSession, "tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(config.ranks)
        out = path = None
        ordinal = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                store, folder = fs.FileSystem.from_uri(at)
                store.create_dir(folder, recursive=True)
                name = f"part-{uuid.uuid4().hex}.tokens"
                path, out = f"{at}/{name}", store.open_output_stream(f"{folder}/{name}")
            for text in batch.column("text").to_pylist():
                ids = enc.encode_ordinary(text) if text else []
                out.write(np.array([*ids, config.end], dtype=config.dtype).tobytes())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.arange(ordinal, ordinal + n)), batch.column("doc_id")], names=["path", "ordinal", "doc_id"])
            ordinal += n
        if out is not None:
            out.close()

    schema = docs.select(F.lit("").alias("path"), F.lit(0).cast("long").alias("ordinal"), "doc_id").schema
    return cut(docs.select("text", "doc_id").mapInArrow(run, schema), "token-files")


def blocks(paths: DataFrame, config: TokenFileConfig) -> DataFrame:
    """(path, block, at, size): the blocks of each file named in ``paths``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                size = store.get_file_info(name).size
                if size % config.width:
                    raise ValueError(f"{path}: {size} bytes are no whole number of ids")
                rows += [{"path": path, "block": k, "at": a, "size": min(config.block, size - a)} for k, a in enumerate(range(0, size, config.block))]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("size", pa.int64())]))

    return paths.select("path").distinct().mapInArrow(run, "path string, block long, at long, size long")


def scan(paths: DataFrame, config: TokenFileConfig) -> DataFrame:
    """(path, ordinal, n_tokens, ended) of each document in the files of ``paths``, separators not counted.

    What follows a file's last separator is a document with ``ended`` false, if there is anything. Empty files have no documents.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, block, at, size in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "at", "size")), strict=True):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as f:
                    f.seek(at)
                    ids = np.frombuffer(f.read(size), dtype=config.dtype)
                ends = np.flatnonzero(ids == config.end)
                starts = np.r_[0, ends + 1]
                lengths = np.r_[ends, len(ids)] - starts  # the last is what follows the last separator
                n = len(ends)
                for a in range(0, n + 1, 50_000):
                    part = lengths[a : a + 50_000]
                    k = np.arange(a, a + len(part))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array([block] * len(part), type=pa.int64()), pa.array(np.where(k == n, -1, k)), pa.array(np.full(len(part), n)), pa.array(part.astype(np.int64))], names=["path", "block", "k", "ends", "n"])

    tasks = blocks(paths, config).repartition(int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "block")
    pieces = cut(tasks.mapInArrow(search, "path string, block long, k long, ends long, n long"), "pieces")
    tails = pieces.where(F.col("k") == -1)
    in_order = Window.partitionBy("path").orderBy("block")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    tails = tails.withColumn("run", F.sum(F.when(F.col("ends") > 0, 1).otherwise(0)).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    open_tokens = F.sum("n").over(Window.partitionBy("path", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
    summary = tails.withColumn("open", open_tokens).select("path", "block", "ends", "open", F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("first"), F.coalesce(F.lag("open").over(in_order), F.lit(0)).alias("carried"), (F.lead("block").over(in_order).isNull()).alias("last"))
    closed = pieces.where(F.col("k") >= 0).select("path", "block", "k", "n").join(summary.select("path", "block", "first", "carried"), ["path", "block"])
    closed = closed.select("path", (F.col("first") + F.col("k")).alias("ordinal"), (F.col("n") + F.when(F.col("k") == 0, F.col("carried")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("ended"))
    left = summary.where(F.col("last") & (F.col("open") > 0)).select("path", (F.col("first") + F.col("ends")).alias("ordinal"), F.col("open").alias("n_tokens"), F.lit(False).alias("ended"))
    return closed.union(left)


def count_tokens(docs: DataFrame, config: TokenFileConfig) -> DataFrame:
    """(doc_id, n_tokens) of each row: the documents are written to flat token files, and the files scanned.

    The end-of-document id isn't counted. Null and empty texts have 0 tokens. Null ids and repeated rows are counted like others;
    other columns are ignored. An empty table gives an empty result.
    """
    written = write_token_files(docs, config)
    counted = scan(written, config)
    return written.join(counted, ["path", "ordinal"]).select("doc_id", "n_tokens")
