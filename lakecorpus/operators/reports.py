"""Reports over encoded texts and corpora: sizes, shares, hits, round trips, offsets, boundaries, dictionaries, losses."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from lakecorpus.functions.batches import list_places
from lakecorpus.functions.metrics import count_of, script_class

from .dedup import checkpointed
from .evaluation import crossed_boundaries
from .training_rows import IGNORE


def _n(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _share(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def kept_sizes(judged: DataFrame, script: str, *keys: str) -> DataFrame:
    """(keys, n_kept, kept_chars, kept_script_chars) of the judged documents whose reason is ''."""
    kept = judged.where(F.col("reason") == "")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_kept"), total(F.length("text")).alias("kept_chars"), total(count_of(F.col("text"), script_class(script))).alias("kept_script_chars"))


def share_rollup(emitted: DataFrame, tokens: Column, *keys: str) -> DataFrame:
    """Documents, tokens and the share of all tokens by each key alone, in one pass (grouping sets); the other keys are null."""
    rows = emitted.select(*keys, tokens.alias("_tokens"))
    sums = rows.groupingSets([[], *[[F.col(k)] for k in keys]], *keys).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("_tokens").cast("long").alias("n_tokens"), F.grouping_id().alias("_set"))
    whole = F.sum(F.when(F.col("_set") == (1 << len(keys)) - 1, F.col("n_tokens"))).over(Window.partitionBy())
    return sums.withColumn("share", _share(F.col("n_tokens"), whole)).where(F.col("_set") != (1 << len(keys)) - 1).drop("_set")


def supervision_sample(rows: DataFrame, first: int, position: str = "doc_id") -> DataFrame:
    """One row about the ``first`` rows (labels, mask) by position: active tokens and those of them with a label. The sample is the feature."""
    sample = rows.orderBy(position).limit(first)
    active = F.size(F.filter("mask", lambda m: m == 1))
    both = F.size(F.filter(F.zip_with("labels", "mask", lambda v, m: (m == 1) & (v != IGNORE)), lambda x: x))
    d = sample.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(active), F.lit(0)).cast("long").alias("n_active"), F.coalesce(F.sum(both), F.lit(0)).cast("long").alias("n_supervised"))
    return d.withColumn("supervised_rate", _share(F.col("n_supervised"), F.col("n_active")))


def hit_rate(tokens: DataFrame, unknown: int, *keys: str) -> DataFrame:
    """(keys, n_tokens, n_chars, n_unknown, n_byte, rates) of tokens (id, start, end, is_byte)."""
    d = tokens.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.sum(F.greatest(F.col("end") - F.col("start"), F.lit(0))).cast("long").alias("n_chars"),
        _n(F.col("id") == unknown).alias("n_unknown"),
        _n(F.col("is_byte")).alias("n_byte"),
    )
    n = F.col("n_tokens")
    return d.withColumns({"chars_per_token": _share(F.col("n_chars"), n), "unknown_rate": _share(F.col("n_unknown"), n), "hit_rate": 1.0 - _share(F.col("n_unknown"), n), "byte_rate": _share(F.col("n_byte"), n)})


def word_hit_rate(spans: DataFrame, unknown: int, *keys: str) -> DataFrame:
    """(keys, n_words, n_hit, word_hit_rate) of spans (text, ids): the words of a span count as hit if none of its tokens is unknown. Without words the rate is 1."""
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    hit = (F.col("text") != "") & ~F.array_contains("ids", unknown)
    d = spans.groupBy(*keys).agg(F.coalesce(F.sum(words), F.lit(0)).cast("long").alias("n_words"), F.coalesce(F.sum(F.when(hit, words)), F.lit(0)).cast("long").alias("n_hit"))
    return d.withColumn("word_hit_rate", _share(F.col("n_hit"), F.col("n_words"), 1.0))


def round_trip(pairs: DataFrame, *keys: str) -> DataFrame:
    """(keys, total, passed, failed, rate) of pairs (text, decoded)."""
    d = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), _n(F.col("text").eqNullSafe(F.col("decoded"))).alias("passed"))
    return d.withColumns({"failed": F.col("total") - F.col("passed"), "rate": _share(F.col("passed"), F.col("total"))})


def first_failures(pairs: DataFrame, first: int = 10, position: str = "doc_id") -> DataFrame:
    """The ``first`` pairs by position that don't come back as they were; a sample by its purpose."""
    return pairs.where(~F.col("text").eqNullSafe(F.col("decoded"))).orderBy(position).limit(first)


_OFFSET_COUNTS = StructType([StructField(n, LongType()) for n in ("n", "bad", "back")])


@F.arrow_udf(_OFFSET_COUNTS)
def _offset_counts(rows: pa.Array, n_chars: pa.Array) -> pa.Array:
    """Of each row's tokens those with offsets, those of them that are out of bounds, and those that start before the one before them."""
    at, flat = list_places(rows)
    start, end = (pc.struct_field(flat, f) for f in ("start", "end"))
    # what is null is no number: it is in no bounds and out of none
    number = lambda x: pc.fill_null(pc.cast(x, pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    start, end, sizes = number(start), number(end), number(n_chars)
    owner = np.repeat(np.arange(len(rows)), np.diff(at))
    nowhere = lambda x: (x == -1) | np.isnan(x)
    real = ~(nowhere(start) & nowhere(end))
    start, end, owner = start[real], end[real], owner[real]
    bad = (start < 0) | (end < start) | (end > sizes[owner])
    first = np.r_[True, owner[1:] != owner[:-1]][: len(owner)]
    before = np.where(first, -1, np.r_[-1, start[:-1]][: len(start)])
    back = start < np.where(np.isnan(before), -1, before)
    of = lambda w=None: np.bincount(owner, w, minlength=len(rows)).astype(np.int64)
    return pa.StructArray.from_arrays([pa.array(x) for x in (of(), of(bad), of(back))], names=_OFFSET_COUNTS.names)


def offset_report(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, tokens_checked, invalid_offsets, non_monotonic) of rows (n_chars, tokens array of (start, end)). Tokens at (-1, -1) don't count."""
    d = rows.select(*keys, _offset_counts("tokens", "n_chars").alias("c")).groupBy(*keys)
    total = lambda c: F.coalesce(F.sum(f"c.{c}"), F.lit(0)).cast("long")
    return d.agg(total("n").alias("tokens_checked"), total("bad").alias("invalid_offsets"), total("back").alias("non_monotonic"))


def boundary_report(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_words, n_boundaries, n_token_boundaries, n_crossed, respected_rate) of words (tokens array of (start, end), boundaries array). Without boundaries the rate is 1."""
    d = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_words"),
        F.sum(F.size("boundaries")).cast("long").alias("n_boundaries"),
        F.sum(F.greatest(F.size("tokens") - 1, F.lit(0))).cast("long").alias("n_token_boundaries"),
        F.sum(crossed_boundaries(F.col("tokens"), F.col("boundaries"))).cast("long").alias("n_crossed"),
    )
    return d.withColumn("respected_rate", _share(F.col("n_boundaries") - F.col("n_crossed"), F.col("n_boundaries"), 1.0))


def compare_baselines(rows: DataFrame, *names: str) -> DataFrame:
    """One row: characters of all texts, and for each tokenizer's count column its tokens and characters per token; one token a character is the baseline."""
    chars = F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long")
    d = rows.agg(chars.alias("chars"), chars.alias("char_tokens"), *[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(f"{n}_tokens") for n in names])
    return d.withColumns({f"{n}_chars_per_token": _share(F.col("chars"), F.col(f"{n}_tokens")) for n in ("char", *names)})


def root_dictionary(analyses: DataFrame, min_confidence: float = 0.60, min_freq: int = 1) -> DataFrame:
    """(root, n, rank) of roots (root, confidence, n words) that are sure and frequent enough, the most frequent first, ties by root."""
    counted = analyses.where(F.col("confidence") >= min_confidence).groupBy("root").agg(F.sum("n").cast("long").alias("n")).where(F.col("n") >= min_freq)
    return ranked(counted, F.col("n").desc(), F.col("root"))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds rank, from 1, in a total order: a range sort, then counts of the partitions before; no task holds all rows."""
    placed = checkpointed(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    before = placed.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # one row for each partition of the sort
    start = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = before.select("_part", start.alias("_start"))
    joined = placed.withColumn("_part", F.shiftright("_at", 33)).join(starts, "_part")
    return joined.withColumn("rank", F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_start", "_at")


def shared_surfaces(entries: DataFrame) -> DataFrame:
    """(surface, ids) of surfaces (surface, id) that more than one id has; ids in order."""
    return entries.groupBy("surface").agg(F.array_sort(F.collect_set("id")).alias("ids")).where(F.size("ids") > 1)


def weighted_loss(batches: DataFrame, *keys: str) -> DataFrame:
    """(keys, loss, n_tokens): mean loss of batches (loss, n_tokens), each weighted by its supervised tokens; without any the loss is null."""
    d = batches.groupBy(*keys).agg(F.sum(F.col("loss") * F.col("n_tokens")).alias("_sum"), F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("long").alias("n_tokens"))
    return d.select(*keys, F.when(F.col("n_tokens") > 0, F.col("_sum") / F.col("n_tokens")).alias("loss"), "n_tokens")


def per_file_budget(rows: DataFrame, budget: int, file: str = "path", position: str = "pos") -> DataFrame:
    """The first rows of each file, so many that all files share the budget evenly, at least one each. The limit is the feature."""
    files = rows.select(file).distinct().agg(F.count(F.lit(1)).alias("n")).first()["n"]
    share = max(1, budget // max(1, files))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(file).orderBy(position))).where(F.col("_r") <= share).drop("_r")


def nucleus(weights: DataFrame, p: float, *keys: str) -> DataFrame:
    """The heaviest tokens (keys, token, weight) that together reach the share p, ties by token, with ``cumulative``, their weight up to and with each.

    A token is in if those before it don't reach p; so there is always one. Keys with a vocabulary each: a window holds one vocabulary at a time.
    """
    w = Window.partitionBy(*keys)
    running = F.sum("weight").over(w.orderBy(F.col("weight").desc(), "token").rowsBetween(Window.unboundedPreceding, 0))
    d = weights.withColumns({"cumulative": running, "_all": F.sum("weight").over(w)})
    return d.where(F.col("cumulative") - F.col("weight") < p * F.col("_all")).drop("_all")


def top_k(scores: DataFrame, k: int, *keys: str) -> DataFrame:
    """The k best (token, score) of each key with rank, ties by token. The limit is the feature; each task keeps only its best before rows are dealt out."""
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "token")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_pair(pairs: DataFrame) -> DataFrame:
    """The most frequent pair (left, right, n), of equal ones the least: one row, by a partial minimum."""
    best = F.min(F.struct((-F.col("n")).alias("_n"), "left", "right", "n"))
    return pairs.agg(best.alias("b")).where(F.col("b").isNotNull()).select("b.left", "b.right", "b.n")


def best_candidate(candidates: DataFrame, *keys: str) -> DataFrame:
    """Of candidates (keys, score, depth, candidate) the one with the highest score, then the least depth, then the least candidate."""
    best = F.max_by(F.struct("candidate", "score", "depth"), F.struct("score", -F.col("depth")))
    tied = candidates.groupBy(*keys, "score", "depth").agg(F.min("candidate").alias("candidate"))
    return tied.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def coverage_heads(covered: DataFrame, kind: str, first: int = 200) -> DataFrame:
    """The first tokens (token, n, kind) of a kind, the rarest first, ties by token; a head for reading."""
    return covered.where(F.col("kind") == kind).orderBy("n", "token").limit(first)


def missing_keys(rows: DataFrame, required: tuple[str, ...], keys: str = "keys") -> Column:
    """Of the required keys, those that a row's array of keys lacks; empty if it has all."""
    return F.array_except(F.array(*map(F.lit, required)), F.col(keys))


def unknown_keys(known: tuple[str, ...], legacy: tuple[str, ...] = (), keys: str = "keys") -> Column:
    """Keys of a row that are neither known nor legacy."""
    return F.array_except(F.col(keys), F.array(*map(F.lit, (*known, *legacy))))


def overlap(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Distinct keys in both; ``isEmpty()`` tells whether two splits are apart."""
    return first.select(key).distinct().join(second.select(key), key, "left_semi")
