"""Merges of pairs learned from counted words, many at a time.

A word is kept as a string of its symbols, each in brackets, so a merge is a replacement within a string, done in the JVM. Pairs and their counts are a table of its own.
Each round takes as many of the commonest pairs as don't touch one another, rewrites the words that have one, and adds what that changes
to the counts, with its sign. Words and counts stay on the executors; the driver sees the first few pairs of each round.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakecorpus.sources.store import Rolling

#: Brackets of a symbol, and what stands between two that no merge may join: noncharacters, which texts don't interchange. In words they count as U+FFFD.
OPEN, CLOSE, BAR = "﷐", "﷑", "﷒"


@dataclass(frozen=True)
class MergeConfig:
    merges: int = 4096
    least: int = 2
    #: Pairs that the driver looks at in a round, so the most that a round merges.
    most_at_once: int = 64


def symbols(word: Column, barred: Column | None = None) -> Column:
    """A word as bracketed characters. ``barred``: the numbers of characters (from 1) behind which no merge may go on."""
    chars = F.filter(F.split(F.translate(word, OPEN + CLOSE + BAR, "�" * 3), ""), lambda c: c != "")
    marked = F.transform(chars, lambda c, i: F.concat(F.lit(OPEN), c, F.lit(CLOSE), F.when(F.array_contains(barred, i + 1), BAR).otherwise("") if barred is not None else F.lit("")))
    return F.array_join(marked, "")


def symbol_list(symbols: Column) -> Column:
    return F.filter(F.split(F.translate(symbols, BAR + OPEN, ""), CLOSE), lambda s: s != "")


def pairs(words: DataFrame, *more: str) -> DataFrame:
    """(left, right, more): a row for each two neighbours in ``symbols`` that may be joined. Of a, a, a there are two."""
    parts = F.filter(F.split("symbols", BAR), lambda p: p != "")
    run = words.select(*more, F.explode(parts).alias("_p")).select(*more, F.filter(F.split(F.translate("_p", OPEN, ""), CLOSE), lambda s: s != "").alias("s")).where(F.size("s") > 1)
    n = F.size("s") - 1
    both = F.arrays_zip(F.slice("s", F.lit(1), n).alias("left"), F.slice("s", F.lit(2), n).alias("right"))
    return run.select(F.explode(both).alias("_b"), *more).select("_b.left", "_b.right", *more)


def _first_untouched(top: list, made: set[str]) -> list:
    """The longest beginning of the ranked pairs whose merges give the same as one after the other.

    A merge changes only counts of pairs with one of its symbols, and what it makes is at most as common as such a pair was before. So pairs that
    share no symbol, and are commoner than the first that does share one, keep their places. A pair of one symbol twice and one whose result is there already can make commoner ones; each has a round of its own.
    """
    taken, used = [], set()
    for k, r in enumerate(top):
        alone = r.left == r.right or r.left + r.right in made
        if used & {r.left, r.right, r.left + r.right} or (alone and k):
            return [t for t in taken if t.n > r.n] or taken[:1]
        taken.append(r)
        if alone:
            return taken
        used |= {r.left, r.right, r.left + r.right}
    return taken


def _merged(col: Column, batch: list) -> Column:
    for r in batch:
        one = lambda s: OPEN + s + CLOSE
        col = F.replace(col, F.lit(one(r.left) + one(r.right)), F.lit(one(r.left + r.right)))
    return col


def learn_merges(counts: DataFrame, config: MergeConfig = MergeConfig()) -> tuple[DataFrame, DataFrame]:
    """Merges (rank, left, right, merged, n) in the order of learning, and the words (word, n, symbols) as they are left.

    ``counts`` has word and n, and barred, an array of places that no merge may cross, if it has that. The commonest pair is merged first, ties by left and right, until
    ``merges`` are learned or no pair is there ``least`` times. Null words don't count. No words give no merges. Words and counts of a round are written to the shared folder and those of the round before deleted; the last words stay there for who reads them.
    """
    spark = counts.sparkSession
    barred = F.col("barred") if "barred" in counts.columns else None
    kept, counted = Rolling(spark, "merge-words"), Rolling(spark, "merge-pairs")
    words = kept.write(counts.where(F.col("word").isNotNull()).select("word", "n", symbols(F.col("word"), barred).alias("symbols")))
    table = counted.write(pairs(words, "n").groupBy("left", "right").agg(F.sum("n").alias("n")))
    learned: list[tuple[int, str, str, str, int]] = []
    made: set[str] = set()
    while len(learned) < config.merges:
        wanted = min(config.most_at_once, config.merges - len(learned)) + 1
        top = table.where(F.col("n") >= config.least).orderBy(F.desc("n"), "left", "right").limit(wanted).collect()
        batch = _first_untouched(top, made)[: config.merges - len(learned)]
        if not batch:
            break
        for r in batch:
            learned.append((len(learned), r.left, r.right, r.left + r.right, r.n))
            made.add(r.left + r.right)
        if len(learned) == config.merges:
            words = words.withColumn("symbols", _merged(F.col("symbols"), batch))
            break
        after = words.withColumn("_after", _merged(F.col("symbols"), batch))
        # the words before, where they change, are kept for one round
        after = kept.write(after.select("word", "n", F.col("_after").alias("symbols"), F.when(F.col("_after") != F.col("symbols"), F.col("symbols")).alias("_before")))
        changed = after.where(F.col("_before").isNotNull())
        gone = pairs(changed.select("n", F.col("_before").alias("symbols")), "n").select("left", "right", (-F.col("n")).alias("n"))
        change = gone.union(pairs(changed, "n").select("left", "right", "n")).groupBy("left", "right").agg(F.sum("n").alias("n"))
        table = counted.write(table.union(change).groupBy("left", "right").agg(F.sum("n").alias("n")).where(F.col("n") > 0))
        words = after.drop("_before")
    counted.drop()
    schema = "rank int, left string, right string, merged string, n long"
    return spark.createDataFrame(learned, schema), words
