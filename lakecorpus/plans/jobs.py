"""Whole jobs as functions: read, work, write, report. Each returns its report as a DataFrame."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakecorpus.operators import mixture, quality, training_rows
from lakecorpus.operators.chunking import split_documents
from lakecorpus.operators.dedup import checkpointed, exact_dedup
from lakecorpus.sources import readers, sinks, store

from .clean import clean_corpus, kept


def _placed(rows: DataFrame, text: Column | None = None) -> DataFrame:
    """(path, pos, text): readers of splittable formats give no places; there rows stand in the order in which Spark reads a file's splits."""
    pos = F.col("pos") if "pos" in rows.columns else F.monotonically_increasing_id()
    return rows.select("path", pos.alias("pos"), (F.col("text") if text is None else text).alias("text"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Numbers rows (path, pos) in the order of the files and of their lines; equal documents are different rows."""
    return readers.with_position(rows).withColumnRenamed("input_pos", "doc_id").drop("pos")


def clean_files(spark: SparkSession, inputs: list[str], out: str, config: quality.QualityConfig = quality.QualityConfig(), near: bool = True, threshold: int = 3) -> DataFrame:
    """Reads text files of any known format under one shared deduplication, writes what is kept as JSON lines, and counts documents by reason."""
    rows = [_placed(readers.read_text(spark, p)) for p in inputs]
    docs = rows[0]
    for r in rows[1:]:
        docs = docs.unionByName(r)
    cleaned = checkpointed(clean_corpus(_numbered(docs), config, near, threshold))
    sinks.write_jsonl(kept(cleaned).select("text"), out)
    return quality.reason_counts(cleaned)


def clean_buckets(docs: DataFrame, out: str, buckets: dict[str, quality.BucketConfig] = quality.BUCKETS) -> DataFrame:
    """Judges rows (doc_id, bucket, source, text) by their bucket's gate, drops repeats within a bucket, writes buckets and counts by bucket and by source."""
    reason = F.lit("unknown_bucket")
    for name, config in buckets.items():
        reason = F.when(F.col("bucket") == name, quality.bucket_reason(F.col("text"), config)).otherwise(reason)
    judged = checkpointed(docs.withColumn("reason", reason))
    sinks.write_buckets(exact_dedup(judged.where(F.col("reason") == ""), within=("bucket",)).drop("reason", "exact_key"), out, "bucket")
    return quality.reason_counts_by_each(judged, "bucket", "source")


def clean_running_text(docs: DataFrame, out: str, max_chars: int = 4000, overlap: int = 0, config: quality.RunningTextConfig = quality.RunningTextConfig()) -> DataFrame:
    """Splits documents into chunks first, then judges and deduplicates the chunks; writes them with chunk_index."""
    chunks = split_documents(docs, max_chars, overlap).withColumn("doc_id", F.struct("doc_id", "chunk_index"))
    judged = checkpointed(chunks.withColumn("reason", quality.running_text_reason(F.col("text"), config)))
    unique = exact_dedup(judged.where(F.col("reason") == ""))
    sinks.write_jsonl(unique.select(F.col("doc_id.doc_id").alias("doc_id"), "chunk_index", "text"), out)
    return quality.reason_counts(judged)


def signature(spark: SparkSession, sources: list[MixSource], *settings) -> str:
    """Tells one state of the inputs and settings of a job from another: sources, and path, size and time of each of their files, however deep."""
    files = [f for s in sources for f in store.listing(spark, s.path)]
    return hashlib.sha256(repr((sources, sorted(files), settings)).encode()).hexdigest()


def is_fresh(spark: SparkSession, out: str, now: str) -> bool:
    """Whether ``out`` is there, finished, and of the same signature."""
    if not store.exists(spark, f"{out}/_SUCCESS"):
        return False
    try:
        seen = spark.read.text(f"{out}.signature").first()
    except AnalysisException:
        return False
    return seen is not None and seen[0] == now


def remember(spark: SparkSession, out: str, now: str) -> None:
    """Written last, so what was broken off isn't fresh."""
    spark.createDataFrame([(now,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}.signature")


@dataclass(frozen=True)
class MixSource:
    path: str
    weight: float
    lang: str = ""
    domain: str = ""
    format: str | None = None
    min_chars: int = 1
    strip_url_lines: bool = False
    keep_lines: str | None = None


def build_mixture(spark: SparkSession, sources: list[MixSource], out: str | None, total_tokens: float | None = None, max_epochs: float = 4.0, sample_docs: int = 2000, seed: int = 0, skip_if_fresh: bool = False) -> DataFrame | None:
    """Measures sources, plans their shares, and writes the mixed texts in one hashed order; without ``out`` only the plan is made.

    Sources are told apart by their place in the list, so two may have one path. With ``skip_if_fresh`` nothing is done, and None
    returned, where ``out`` was made from the same files and settings.
    """
    now = signature(spark, sources, total_tokens, max_epochs, sample_docs, seed) if out else ""
    if skip_if_fresh and out and is_fresh(spark, out, now):
        return None
    docs = None
    for k, s in enumerate(sources):
        text = readers.keep_lines(F.col("text"), s.strip_url_lines, s.keep_lines) if s.strip_url_lines or s.keep_lines else F.col("text")
        rows = _placed(readers.read_text(spark, s.path, s.format), text).where(F.length("text") >= max(s.min_chars, 1))
        rows = _numbered(rows).withColumn("source", F.lit(str(k)))
        docs = rows if docs is None else docs.unionByName(rows)
    about = spark.createDataFrame([(str(k), s.path, s.lang, s.domain, float(s.weight)) for k, s in enumerate(sources)], "source string, path string, lang string, domain string, weight double")
    planned = checkpointed(mixture.plan(mixture.measure(docs, sample=sample_docs), about, total_tokens=total_tokens, max_epochs=max_epochs))
    if out is None:
        return planned.join(about.drop("weight"), "source")
    emitted = checkpointed(mixture.emit(docs, planned, seed=seed))
    sinks.write_jsonl(mixture.shuffled(emitted, seed, "doc_id", "copy").select("text"), out)
    remember(spark, out, now)
    came = mixture.report(emitted, "source").withColumnsRenamed({"n_docs": "emitted_docs", "n_tokens": "emitted_tokens"})
    return planned.join(about.drop("weight"), "source").join(came, "source", "left")


def extract_seed(records: DataFrame, out: str, per_domain: int = 2000, min_chars: int = 80, max_chars: int = 2000) -> DataFrame:
    """Picks abstracts (doc_id, meta, text) of a length band, so many for each domain; writes them and counts by domain."""
    within = records.where(F.length("text").between(min_chars, max_chars))
    picked = checkpointed(mixture.capped_seed(within, mixture.classify_record(F.col("meta"), F.col("text")), per_domain))
    sinks.write_jsonl(picked.select("text", "domain"), out)
    return picked.groupBy("domain").count()


def build_training_rows(docs: DataFrame, out: str, max_length: int = 2048, shard_tokens: int | None = None, ignored: tuple[int, ...] = (), eos: int = 256, pack: bool = True) -> DataFrame:
    """Byte-level rows with labels, packed or truncated, written as Parquet (in shards of a token budget), and their gate metrics."""
    rows = docs.select("doc_id", training_rows.byte_ids(F.coalesce("text", F.lit(""))).alias("ids")).where(F.size("ids") > 0)
    rows = rows.withColumn("labels", training_rows.labels(F.col("ids"), F.array(*map(F.lit, ignored)).cast("array<int>")))
    if pack:
        rows = training_rows.pack_rows(rows, max_length, eos).withColumn("doc_id", F.col("pack_group") * F.lit(1 << 32) + F.col("pack"))
    else:
        rows = training_rows.truncate(rows, max_length)
    rows = checkpointed(rows.select("doc_id", "ids", "labels"))
    if shard_tokens:
        sizes = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("long").alias("grp"), F.col("doc_id").alias("position"), F.size("ids").alias("size"))
        at = training_rows.shard_ids(sizes, shard_tokens).select(F.col("position").alias("doc_id"), (F.col("shard") * 16 + F.col("grp")).alias("shard"))
        rows.join(at, "doc_id").repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(out)
    else:
        rows.write.mode("overwrite").parquet(out)
    return training_rows.gate_metrics(rows, unk=-1)
