"""Quality rules with adaptive thresholds, DataFrame functions only.

Fixed cutoffs are replaced by fences that follow from mergeable quantile
sketches (KLL) and nothing else. Two sketches are built for each rule and each (language, source), one of all documents and one of those
that show what the rule is about at all, partially on each task and merged after the shuffle; the sketches of sources
are merged into those of their language and those into one for the corpus. The fences
are then joined to the documents and the filter applied.

Most texts have no symbols or repeated lines whatever, so quantiles over all documents are 0 there. What the group as a whole shows of it is then the
fence: the share of documents that have any, times the lower quartile of those (junk, which has most, doesn't raise it). It is a rate: a long document may have
more of it than a short one. Its count is held against the
count that the fence gives for its length, give or take the deviation of a count of that size. So one repeated line of three
passes where few lines repeat as a rule, three of four hundred do, and thirty of ninety don't.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import all_columns, cut, group_key, row, words

#: Characters counted as symbols (fixed values).
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class QualityConfig:
    """Parameters of the fences.

    A rule's upper fence in a group is ``q75 + spread * (q75 - q25)``, and for events (all rules but the length of words) at least the share of documents that
    have any times the lower quartile of those; its lower fence is ``q25 - spread * (q75 - q25)``, where that is
    above 0. Shares are drawn towards that of the wider group with the weight of ``least_docs`` documents; the quartile is the wider group's where fewer than ``least_docs`` have any. A document may be over the count that its fence gives by ``tolerance`` standard
    deviations of that count and one event more. A source's upper fence is at
    most ``over_language`` times that of its language, so a source that consists of junk can't
    set its own standard. Groups of fewer than ``least_docs`` documents use the next wider group.
    Sketches hold ``sketch_k`` items a level; up to as many values the quantiles are exact, beyond
    it the rank error is about 2.3 / sketch_k.
    """

    sketch_k: int = 1024
    spread: float = 3.0
    tolerance: float = 2.0
    least_docs: int = 30
    over_language: float = 1.5
    min_words: int = 20
    max_repeat_percent: int = 30


#: Rule: count, what it is a share of, and the size of one event (a window that is there twice covers 16 words).
COUNTS = {"symbol_ratio": ("n_symbols", "n_words", 1.0), "dup_line_ratio": ("n_dup_lines", "n_lines", 1.0), "repeat_ratio": ("n_repeat_words", "n_words", 2.0 * WINDOW), "stutter_ratio": ("n_stutters", "n_words", 1.0), "word_length": ("word_chars", "n_words", 1.0)}
RULES = tuple(COUNTS)


def _window_hashes(hashes: Column, n: Column) -> Column:
    return F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])))


def _covered(starts: Column) -> Column:
    """Number of positions covered by windows at ascending ``starts``."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(
        starts,
        zero,
        lambda a, s: F.struct((s + WINDOW).alias("end"), (a["n"] + WINDOW - F.greatest(F.lit(0), a["end"] - s)).alias("n")),
        lambda a: a["n"],
    )


def base_metrics(docs: DataFrame) -> DataFrame:
    """Adds ``_q``, a struct of the counts of each whole text, to ``docs``, whose names must not begin with an underscore but for ``_row``, ``_lang`` and ``_source``.

    Equal 8-word windows are found by 64-bit hashes within one text. A null or empty text has
    zero counts. Each step is a projection whose arrays the next one uses more than once, so
    the optimizer keeps them apart.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda s: s.rlike("[^\\x20\\x09-\\x0D]"))
    d = docs.withColumns({"_w": words(F.col("text")), "_lines": lines})
    d = d.withColumns({"_n": F.size("_w"), "_h": F.transform("_w", lambda w: F.xxhash64(w)), "_chars": F.length(F.array_join("_w", "")).cast("long")})
    d = d.withColumn("_win", _window_hashes(F.col("_h"), F.col("_n")))
    d = d.withColumn("_again", F.size(F.array_distinct("_win")) < F.size("_win"))
    d = d.withColumn("_sorted", F.when(F.col("_again"), F.array_sort(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = lambda i: F.get(F.col("_sorted"), i)
    same = lambda i, j: F.coalesce(at(i)["h"] == at(j)["h"], F.lit(False))
    twice = F.filter(F.sequence(F.lit(0), F.size("_sorted") - 1), lambda i: same(i, i - 1) | same(i, i + 1))
    d = d.withColumn("_starts", F.when(F.col("_again"), F.array_sort(F.transform(twice, lambda i: at(i)["i"]))))
    counts = F.struct(
        F.col("_n").cast("long").alias("n_words"),
        F.col("_chars").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_again"), _covered(F.col("_starts"))).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.filter("_h", lambda h, i: h == F.get(F.col("_h"), i - 1))).cast("long").alias("n_stutters"),
    )
    return d.withColumn("_q", counts).select(*all_columns(docs), "_q")


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def rule_values() -> dict[str, Column]:
    """The value of each adaptive rule, from the counts in ``_q``."""
    return {r: _ratio(f"_q.{k}", f"_q.{n}") for r, (k, n, _) in COUNTS.items()}


def fences(measured: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """Fences of each (``_lang``, ``_source``) in ``measured``, from merged sketches.

    ``measured`` has the two keys and ``_q``; documents that fail the base rule don't count. A group whose documents all
    fail it has no row. The result has one row for each group, whatever the number of documents.
    """
    values = rule_values()
    sound = measured.where(~base_failed(config)).select("_lang", "_source", *[v.alias(r) for r, v in values.items()])
    k = F.lit(config.sketch_k)
    seen = lambda r: F.when(F.col(r) > 0, F.col(r))
    first = [F.count(F.lit(1)).alias("_docs")]
    for r in RULES:
        first += [F.kll_sketch_agg_double(r, k).alias(r), F.count(seen(r)).alias(f"{r}_n"), F.kll_sketch_agg_double(seen(r), k).alias(f"{r}_some")]
    by_source = cut(sound.groupBy("_lang", "_source").agg(*first).withColumn("_corpus", F.lit(1)), "quality-sketches")

    def merged(*keys: str) -> DataFrame:
        again = [F.sum("_docs").alias("_docs")]
        for r in RULES:
            again += [F.kll_merge_agg_double(r, k).alias(r), F.sum(f"{r}_n").alias(f"{r}_n"), F.kll_merge_agg_double(f"{r}_some", k).alias(f"{r}_some")]
        return by_source.groupBy(*keys).agg(*again)

    def summed(sketches: DataFrame, tag: str, *keys: str) -> DataFrame:
        """What the fences take from the sketches of a group: its size and, for each rule, bounds from quantiles, documents that show it at all, and their lower quartile."""
        out = [F.col("_docs")]
        for r in RULES:
            q25, q75 = (F.kll_sketch_get_quantile_double(r, F.lit(q)) for q in (0.25, 0.75))
            some = F.when(F.col(f"{r}_n") > 0, F.kll_sketch_get_quantile_double(f"{r}_some", F.lit(0.25))).otherwise(0.0)
            out += [(q75 + config.spread * (q75 - q25)).alias(f"{r}_high"), F.col(f"{r}_n"), some.alias(f"{r}_some")]
            if r == "word_length":
                out.append(F.greatest(F.lit(0.0), q25 - config.spread * (q75 - q25)).alias(f"{r}_low"))
        return sketches.select(*keys, F.struct(*out).alias(tag))

    top = summed(merged("_corpus"), "_all", "_corpus")
    lang = summed(merged("_lang"), "_by_lang", "_lang")
    source = summed(by_source, "_by_source", "_lang", "_source", "_corpus")
    both = source.join(lang, "_lang").join(top, "_corpus")
    tags, least = ("_all", "_by_lang", "_by_source"), config.least_docs
    picks = []
    for r in RULES:
        share, typical, high = F.lit(0.0), F.lit(0.0), []
        for tag in tags:
            # shares lean on those of the wider group, quartiles are its own from enough documents on
            share = (F.col(f"{tag}.{r}_n") + least * share) / (F.col(f"{tag}._docs") + least) if tag != "_all" else F.col(f"{tag}.{r}_n") / F.col(f"{tag}._docs")
            typical = F.when(F.col(f"{tag}.{r}_n") >= least, F.col(f"{tag}.{r}_some")).otherwise(typical) if tag != "_all" else F.col(f"{tag}.{r}_some")
            bound = F.col(f"{tag}.{r}_high")
            high.append(bound if r == "word_length" else F.greatest(bound, share * typical))
        wide = F.when(F.col("_by_lang._docs") >= least, high[1]).otherwise(high[0])
        near = F.least(high[2], config.over_language * wide)
        picks.append(F.when(F.col("_by_source._docs") >= least, near).otherwise(wide).alias(f"{r}_high"))
    low = [F.col(f"{tag}.word_length_low") for tag in tags]
    picks.append(F.when(F.col("_by_source._docs") >= least, low[2]).when(F.col("_by_lang._docs") >= least, low[1]).otherwise(low[0]).alias("word_length_low"))
    return both.select("_lang", "_source", *picks)


def base_failed(config: QualityConfig = QualityConfig()) -> Column:
    n, again = F.col("_q.n_words"), F.col("_q.n_repeat_words")
    return (n < config.min_words) | (100 * again > config.max_repeat_percent * n)


def passes(config: QualityConfig = QualityConfig()) -> Column:
    """True where a document with fences joined to it lies within all of them."""

    def slack(due: Column, event: float) -> Column:
        """Deviation of a count that comes in events; the event more keeps a fence of 0 from rejecting the first."""
        return config.tolerance * F.sqrt(event * (due + event))

    ok = F.lit(True)
    for r, (k, n, event) in COUNTS.items():
        due = F.col(f"{r}_high") * F.col(f"_q.{n}")
        ok = ok & F.coalesce(F.col(f"_q.{k}") <= due + slack(due, event), F.lit(True))
    due = F.col("word_length_low") * F.col("_q.n_words")
    return ok & F.coalesce(F.col("_q.word_chars") >= due - slack(due, 1.0), F.lit(True))


def quality_rules(docs: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """Measures each document and judges it by base rule and adaptive fences.

    Needs ``doc_id, text, lang, source``; any may be null, other columns are ignored. Returns one row for each input row
    with doc_id, the counts, base_failed and kept. Null and empty texts fail the base rule. Null languages and sources are groups like
    others. Repeated rows are judged alike. An empty table gives an empty result.
    """
    d = docs.select("doc_id", "text", group_key("lang").alias("_lang"), group_key("source").alias("_source"))
    measured = cut(base_metrics(d).drop("text"), "quality-counts")
    judged = measured.join(fences(measured, config), ["_lang", "_source"], "left")
    return judged.select("doc_id", "_q.n_words", "_q.word_chars", "_q.n_symbols", "_q.n_dup_lines", "_q.n_repeat_words", base_failed(config).alias("base_failed"), (~base_failed(config) & passes(config)).alias("kept"))


def keep_quality(docs: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns, whatever their names.

    The documents are written once with their counts, so each text is measured once, and never shuffled while the fences fit a broadcast.
    """
    d = docs.select(row(docs), "text", group_key("lang").alias("_lang"), group_key("source").alias("_source"))
    measured = cut(base_metrics(d).drop("text"), "quality-documents")
    judged = measured.join(fences(measured, config), ["_lang", "_source"], "left")
    return judged.where(~base_failed(config) & passes(config)).select("_row.*")
