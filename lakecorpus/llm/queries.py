"""The queries of this subpackage: one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, conversation_repair, language_id, quality_classifier, token_counts
from .common import table
from .decontaminate import leaks
from .html_extract import extract_text
from .importance_resampling import resample
from .line_dedup import dedup_lines
from .ngram_join import similar_classes
from .suffix_dedup import remove_repeats
from .quality_rules import quality_rules


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language_id.held_out(F.col("doc_id")))
    profiles = language_id.train_profiles(docs.where(~F.col("held_out")).select("text", "lang"))
    return language_id.identify(docs, profiles, keep=("doc_id", "held_out"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = token_counts.TokenFileConfig(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), config)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    both = bpe.encode(table(spark, sf_dir, "documents"), path, decoded=True)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = (F.col("n_bytes") - F.octet_length("kept")).cast("long")
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    config = chat_format.ChatConfig(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(probe)
    return chat_format.digests(chat_format.format_chat(rows, config), config)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.train(quality_classifier.sample_labelled(docs, table(spark, sf_dir, "labels")))
    judged = docs.withColumn("held_out", quality_classifier.held_out(F.col("doc_id")))
    return quality_classifier.classify(judged, model, keep=("doc_id", "held_out"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.mark_faults(conversation_repair.damage(table(spark, sf_dir, "conversations")))
    return conversation_repair.digests(conversation_repair.repair(rows))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_language_id": op1_language_id, "op2_html_extraction": op2_html_extraction, "op3_decontamination": op3_decontamination, "op4_token_counts": op4_token_counts, "op5_quality_rules": op5_quality_rules, "op6_bpe": op6_bpe, "op7_ngram_join": op7_ngram_join, "op8_suffix_dedup": op8_suffix_dedup, "op9_chat_format": op9_chat_format, "op10_line_dedup": op10_line_dedup, "op11_quality_classifier": op11_quality_classifier, "op12_conversation_repair": op12_conversation_repair, "op13_importance_resampling": op13_importance_resampling}


def oracle_sql() -> dict[str, str]:
    from .sql import SQL

    return dict(SQL)
