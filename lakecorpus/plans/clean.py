"""Corpus cleaning from end to end: quality gate, then exact and near deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakecorpus.functions import hashing as H
from lakecorpus.operators import dedup
from lakecorpus.operators.quality import QualityConfig, quality_reason


def clean_corpus(docs: DataFrame, config: QualityConfig = QualityConfig(), near: bool = False, threshold: int = 3, position: str = "doc_id") -> DataFrame:
    """Adds reason to each document: the rule it fails, ``duplicate``, or '' if it is kept.

    Rejected documents don't count as first ones. Positions are unique. With ``near``, near duplicates are ``duplicate`` as well.
    """
    reason = quality_reason(F.col("text"), config)
    if near:
        judged = dedup.checkpointed(docs.select(position, reason.alias("reason")))
        passed = docs.join(judged.where(F.col("reason") == "").select(position), position, "left_semi")
        kept = dedup.near_dedup(passed, threshold, position=position).select(position)
    else:
        # judged once: positions, reasons and keys are written, the texts are not
        judged = docs.select(position, "text", reason.alias("reason")).select(position, "reason", F.when(F.col("reason") == "", H.exact_key(F.col("text"))).alias("_k"))
        judged = dedup.checkpointed(judged)
        kept = judged.where(F.col("_k").isNotNull()).groupBy("_k").agg(F.min(position).alias(position)).select(position)
    marked = judged.select(position, "reason").join(kept.withColumn("_kept", F.lit(True)), position, "left")
    fate = marked.select(position, F.when((F.col("reason") == "") & F.col("_kept").isNull(), "duplicate").otherwise(F.col("reason")).alias("reason"))
    return docs.join(fate, position)


def kept(cleaned: DataFrame) -> DataFrame:
    return cleaned.where(F.col("reason") == "").drop("reason")
