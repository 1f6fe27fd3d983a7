"""Benchmark decontamination by MinHash containment search, DataFrame functions only.

Test items are short and documents long, so the search estimates containment (the share of an item's shingles that a
document has) and not resemblance. Items are partitioned by size. Each partition has its own
sketch width: the minima of so many hash functions over the item's shingles, and its own number of
minima that a document must have, such that an item at the threshold is missed with a probability under ``miss``.
Documents of any length are probed whole: a minimum counts as met if any shingle of the document hashes to it.
Candidates are verified on the shingles themselves.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, row

WORD = "[\\p{L}\\p{N}]+"


@dataclass(frozen=True)
class ContainmentConfig:
    shingle_words: int = 5
    containment: float = 0.8
    #: Upper sizes (distinct shingles) of the partitions of items, and the hash functions of each; the last has no upper size.
    sizes: tuple[int, ...] = (8, 32, 128)
    widths: tuple[int, ...] = (8, 16, 24, 32)
    miss: float = 1e-6
    #: Items of fewer words are left out. An item of one or two common words is in nearly every text; whoever has such items decides here.
    least_words: int = 1


def least_matches(width: int, containment: float, miss: float) -> int:
    """Most matches that may be asked for, so that fewer come with a probability under ``miss`` at the threshold.

    At least 1. Minima of an item are drawn with replacement from its shingles.
    """
    below, k = 0.0, 0
    while k < width:
        below += math.comb(width, k) * containment**k * (1 - containment) ** (width - k)
        if below > miss:
            break
        k += 1
    return max(1, k)


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _runs(w: str, k: int, hashed: bool) -> Column:
    """The distinct runs of k in the column of words, or of hashes of words and then hashed, too; none if there are fewer."""
    c = F.col(w)
    if hashed:
        return F.when(F.size(c) >= k, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(c) - k), lambda i: F.xxhash64(*[F.get(c, i + j) for j in range(k)])))).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.size(c) >= k, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(c) - k + 1), lambda i: F.array_join(F.slice(c, i, k), " ")))).otherwise(F.array().cast("array<string>"))


def _item_runs(w: str, config: ContainmentConfig, hashed: bool) -> Column:
    """What a text must contain of an item: its runs of ``shingle_words`` words; of a shorter item the run of all its words."""
    out = _runs(w, config.shingle_words, hashed)
    for k in range(1, config.shingle_words):
        short = _runs(w, k, hashed) if k >= config.least_words else F.array().cast(f"array<{'bigint' if hashed else 'string'}>")
        out = F.when(F.size(w) == k, short).otherwise(out)
    return out


def _short_lengths(items: DataFrame, config: ContainmentConfig) -> tuple[int, ...]:
    """The numbers of words of items shorter than a shingle; ``shingle_words`` - 1 numbers at most."""
    n = items.select(F.size(words(F.col("text"))).alias("n")).where(F.col("n").between(config.least_words, config.shingle_words - 1))
    return tuple(sorted(r.n for r in n.distinct().collect()))


def _text_runs(w: str, lengths: tuple[int, ...], hashed: bool) -> Column:
    return F.concat(*[_runs(w, k, hashed) for k in lengths])


def _item() -> Column:
    """Tells items apart, also those without an id."""
    return F.xxhash64("item_id", "text")


def item_sketches(items: DataFrame, config: ContainmentConfig) -> DataFrame:
    """(item, least, h, times): for each item with a word, the minima of its partition's hash functions."""
    w = items.select(_item().alias("item"), words(F.col("text")).alias("w"))
    s = w.withColumn("hw", F.transform("w", lambda x: F.xxhash64(x))).withColumn("s", _item_runs("hw", config, True)).where(F.size("s") > 0)
    n = F.size("s")
    width, least = F.lit(config.widths[-1]), F.lit(least_matches(config.widths[-1], config.containment, config.miss))
    for upper, wide in reversed(list(zip(config.sizes, config.widths, strict=False))):
        width = F.when(n <= upper, F.lit(wide)).otherwise(width)
        least = F.when(n <= upper, F.lit(least_matches(wide, config.containment, config.miss))).otherwise(least)
    # the shingle at which a hash function has its minimum; equal minima count as often as they are drawn
    minima = F.transform(F.sequence(F.lit(1), width), lambda f: F.array_min(F.transform("s", lambda x: F.struct(F.xxhash64(f, x).alias("m"), x.alias("x"))))["x"])
    drawn = s.select("item", least.alias("least"), F.explode(minima).alias("h"))
    return drawn.groupBy("item", "least", "h").agg(F.count(F.lit(1)).alias("times"))


def _probed(docs: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    d = docs.select(F.xxhash64("text").alias("_t1"), F.xxhash64(F.lit(1), "text").alias("_t2"), words(F.col("text")).alias("w"))
    d = d.withColumn("hw", F.transform("w", lambda x: F.xxhash64(x)))
    return d.select("_t1", "_t2", F.explode(_text_runs("hw", lengths, True)).alias("h"))


def contained(docs: DataFrame, items: DataFrame, config: ContainmentConfig = ContainmentConfig()) -> DataFrame:
    """(_t1, _t2, item_id, n_shingles, n_shared): the items that the text hashed to (_t1, _t2) contains.

    Documents meet the sketches in a join whose build side the planner broadcasts only while its size allows, and candidates are counted
    by text, so copies of a document count once.
    """
    lengths = (*_short_lengths(items, config), config.shingle_words)
    sketches = cut(item_sketches(items, config), "item-sketches")
    hits = _probed(docs, lengths).join(sketches, "h")
    found = hits.groupBy("_t1", "_t2", "item", "least", "h").agg(F.first("times").alias("times"))
    found = found.groupBy("_t1", "_t2", "item", "least").agg(F.sum("times").alias("met")).where(F.col("met") >= F.col("least")).select("_t1", "_t2", "item")
    found = cut(found, "candidates")
    # exact verification on whole texts, one row for each text and item
    texts = docs.select(F.xxhash64("text").alias("_t1"), F.xxhash64(F.lit(1), "text").alias("_t2"), "text").join(found.select("_t1", "_t2").distinct(), ["_t1", "_t2"], "left_semi")
    mine = texts.withColumn("w", words(F.col("text"))).select("_t1", "_t2", F.explode(_text_runs("w", lengths, False)).alias("s")).distinct()
    theirs = items.select(_item().alias("item"), "item_id", words(F.col("text")).alias("w")).select("item", "item_id", _item_runs("w", config, False).alias("s")).where(F.size("s") > 0)
    theirs = theirs.select("item", "item_id", F.size("s").alias("n_shingles"), F.explode("s").alias("s"))
    shared = mine.join(theirs, "s").groupBy("_t1", "_t2", "item", "item_id", "n_shingles").agg(F.countDistinct("s").alias("n_shared"))
    t = round(config.containment * 1000)
    sure = shared.where(1000 * F.col("n_shared") >= t * F.col("n_shingles")).join(found, ["_t1", "_t2", "item"], "left_semi")
    return sure.select("_t1", "_t2", "item_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.col("n_shared").cast("long").alias("n_shared"))


def leaks(docs: DataFrame, items: DataFrame, config: ContainmentConfig = ContainmentConfig()) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment): each document with each item that it contains.

    A document contains an item if it has at least ``containment`` of the item's distinct shingles of five
    lower-case words (letters and digits); an item of fewer words if it has them in a row. Null texts and those without a word match nothing; a
    null id of either side is returned like others. Repeated rows of documents give repeated rows; items in several rows with one id and text
    count once, those with one id and different texts each. Other columns are ignored. Empty tables give an empty result.
    """
    found = cut(contained(docs, items.select("item_id", "text").distinct(), config), "leaks")
    mine = docs.select("doc_id", F.xxhash64("text").alias("_t1"), F.xxhash64(F.lit(1), "text").alias("_t2"))
    return mine.join(found, ["_t1", "_t2"]).select("doc_id", "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, config: ContainmentConfig = ContainmentConfig()) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns, whatever their names; null and empty texts stay."""
    found = cut(contained(docs, items.select("item_id", "text").distinct(), config).select("_t1", "_t2").distinct(), "leaking-texts")
    mine = docs.select(row(docs), F.xxhash64("text").alias("_t1"), F.xxhash64(F.lit(1), "text").alias("_t2"))
    return mine.join(found, ["_t1", "_t2"], "left_anti").select("_row.*")
