"""A corpus from raw documents to tokens: quality, repeated lines, near duplicates, test items, encoding.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next one's docs. Stages take the five columns of documents, any of which may be null, and
leave out others; an empty table gives an empty one. Rows that are there twice are judged alike, unless a stage is about repeats. Texts are taken whole, however long.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakecorpus.llm import bpe
from lakecorpus.llm.common import cut, drop_cut, drop_cuts, table
from lakecorpus.llm.decontaminate import drop_contaminated
from lakecorpus.llm.line_dedup import dedup_lines
from lakecorpus.llm.ngram_join import keep_one_of_each
from lakecorpus.llm.quality_rules import keep_quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject: null and empty texts fail the base rule. Null languages and sources are groups like others."""
    return keep_quality(_columns(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; a document of which nothing is left goes, n_chars follows the text.

    A null text has no lines and stays as it is. Rows of one doc_id and text are one document and treated alike; null ids come last.
    """
    out = dedup_lines(_columns(docs))
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return _columns(out.where(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", chars))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates, that of the least doc_id (null ids last). Texts without a word and null ones stay; of rows that are there twice one does."""
    return keep_one_of_each(_columns(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain an item of the benchmark; a null text contains none, an item without words is in none."""
    return drop_contaminated(_columns(docs), table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document with doc_id, lang and source; a null text has none."""
    encoded = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), keep=("doc_id", "lang", "source"))
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


def _stage(f):
    """A stage begins when the one before it is written, so what that one kept on disk for its own use can go."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_cuts(spark)
        return f(spark, docs, sf_dir)

    return run


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("decontamination", decontaminate), ("encoding", encode)]
STAGES = [(name, _stage(f)) for name, f in STAGES]

#: SQL has no quantile sketches, MinHash forest or merge rounds; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = written = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        docs = cut(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"), listed=False)
        if k:
            drop_cut(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
