"""Evaluation reports: error rates, coverage, spans, rewards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakecorpus.functions import textnorm as N
from lakecorpus.functions.metrics import bound, graphemes


def edit_distance(a, b) -> int:
    """Insertions, deletions and substitutions between any two sequences: a column of the table as bits, one for each step down or up."""
    if len(a) > len(b):
        a, b = b, a
    at: dict = {}
    for k, v in enumerate(a):
        at[v] = at.get(v, 0) | 1 << k
    mask = (1 << len(a)) - 1
    up, down, of = mask, 0, at.get
    for v in b:
        same = of(v, 0)
        x = same | down
        diagonal = (((same & up) + up) ^ up) | same
        right = ((down | mask & ~(diagonal | up)) << 1) | 1
        left = (up & diagonal) << 1
        up = mask & (left | ~(x | right))
        down = right & x
    return len(b) + up.bit_count() - down.bit_count()


def distance_udf(unit: str = "codepoint"):
    """A UDF with the distance of two strings in code points, graphemes or words."""
    cut = {"codepoint": list, "grapheme": graphemes, "word": str.split}.get(unit)
    if cut is None:
        raise ValueError(f"unknown unit {unit!r}")

    @F.pandas_udf("long")
    def run(a, b):
        import pandas as pd

        return pd.Series([None if x is None or y is None else edit_distance(cut(x), cut(y)) for x, y in zip(a, b, strict=True)], dtype="Int64")

    return run


def grapheme_distance_udf():
    """A UDF with the distances of two strings in code points and in graphemes; where no character joins another they are the same."""

    @F.pandas_udf("codepoint long, grapheme long")
    def run(a, b):
        import pandas as pd

        out = []
        for x, y in zip(a, b, strict=True):
            if x is None or y is None:
                out.append((None, None))
                continue
            d = edit_distance(x, y)
            # a mark alone in front counts as a base, so the distinct characters tell only in one direction
            parted = all(len(graphemes("a" + c)) == 2 for c in set(x) | set(y))
            out.append((d, d if parted else edit_distance(graphemes(x), graphemes(y))))
        return pd.DataFrame(out, columns=["codepoint", "grapheme"]).astype("Int64")

    return run


def length_udf(unit: str = "codepoint"):
    cut = {"codepoint": list, "grapheme": graphemes, "word": str.split}[unit]

    @F.pandas_udf("long")
    def run(a):
        import pandas as pd

        return pd.Series([None if x is None else len(cut(x)) for x in a], dtype="Int64")

    return run


def error_rate(pairs: DataFrame, *keys: str) -> DataFrame:
    """Micro-averaged character error rate of (pred, ref): all edits over all reference characters; an empty reference counts as 1."""
    d = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.levenshtein("pred", "ref")).cast("long").alias("edits"), F.sum(F.greatest(F.length("ref"), F.lit(1))).cast("long").alias("ref_chars"))
    return d.withColumn("cer", F.col("edits") / F.col("ref_chars"))


def ocr_report(pairs: DataFrame, threshold: float | None = None) -> DataFrame:
    """One row: raw, folded and grapheme error rates, word error rate, exact lines and rejections of (pred, ref, confidence).

    With a threshold, rows of less or no confidence are rejected and count for nothing else. Null texts count as empty.
    """
    rejected = (F.col("confidence").isNull() | (F.col("confidence") < threshold)) if threshold is not None else F.lit(False)
    fold = lambda c: N.squash(N.fold_control(F.col(c)))
    kept = ~F.col("_out")
    d = pairs.withColumn("_out", rejected).withColumns({c: F.when(kept, F.coalesce(c, F.lit(""))) for c in ("pred", "ref")})
    d = d.withColumns({"_p": fold("pred"), "_r": fold("ref")})
    parts = {"raw": ("ref", "codepoint"), "norm": ("_r", "codepoint"), "grapheme": ("ref", "grapheme"), "word": ("_r", "word")}
    d = d.withColumn("_both", grapheme_distance_udf()("pred", "ref"))
    d = d.withColumns({"_norm_d": distance_udf()("_p", "_r"), "_word_d": distance_udf("word")("_p", "_r"), "_raw_d": F.col("_both.codepoint"), "_grapheme_d": F.col("_both.grapheme")})
    d = d.withColumns({f"_{name}_n": F.greatest(length_udf(unit)(r), F.lit(1)) for name, (r, unit) in parts.items()})
    total = lambda c: F.sum(F.when(kept, F.col(c)))
    rates = [F.coalesce(total(f"_{n}_d") / total(f"_{n}_n"), F.lit(0.0)).alias("wer" if n == "word" else f"{n}_cer") for n in parts]
    return d.agg(
        F.count(F.when(kept, 1)).alias("n"),
        *rates,
        F.coalesce(F.avg(F.when(kept, (F.col("_p") == F.col("_r")).cast("double"))), F.lit(0.0)).alias("line_exact"),
        F.coalesce(F.avg(F.col("_out").cast("double")), F.lit(0.0)).alias("rejection_rate"),
    )


def token_histogram(docs: DataFrame, words: Column) -> DataFrame:
    return docs.select(F.explode(words).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def vocabulary_coverage(vocabulary: DataFrame, histogram: DataFrame, rare: int = 5) -> DataFrame:
    """Adds n and kind to a vocabulary: zero, rare or common tokens."""
    n = F.coalesce("n", F.lit(0))
    kind = F.when(n == 0, "zero").when(n < rare, "rare").otherwise("common")
    return vocabulary.join(histogram, "token", "left").select("token", n.alias("n"), kind.alias("kind"))


def chars_per_token(tokens: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_tokens, n_chars, chars_per_token) of tokens (start, end)."""
    d = tokens.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_tokens"), F.sum(F.col("end") - F.col("start")).alias("n_chars"))
    return d.withColumn("chars_per_token", F.col("n_chars") / F.col("n_tokens"))


def crossed_boundaries(tokens: Column, boundaries: Column) -> Column:
    """How many boundaries lie inside a token (start, end); none do in a text that respects them."""
    return bound(tokens, lambda ts: F.size(F.filter(boundaries, lambda b: F.exists(ts, lambda t: (t["start"] < b) & (b < t["end"])))))


def contained_tokens(tokens: Column, spans: Column) -> Column:
    """Tokens that lie in one of the spans."""
    return bound(spans, lambda ss: F.filter(tokens, lambda t: F.exists(ss, lambda s: (t["start"] >= s["start"]) & (t["end"] <= s["end"]))))


def offset_faults(tokens: Column) -> Column:
    """Tokens that end before they start or start before the one before them; tokens without offsets don't count."""
    real = F.filter(tokens, lambda t: t["start"] >= 0)

    def faults(r):
        back = F.filter(r, lambda t, i: t["start"] < F.get(r, i - 1)["start"])
        return F.size(F.filter(r, lambda t: t["end"] < t["start"])) + F.size(back)

    return bound(real, faults)


def reward_report(rewards: DataFrame, *keys: str) -> DataFrame:
    return rewards.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("reward").alias("mean_reward"), F.min("reward").alias("min_reward"), F.max("reward").alias("max_reward"))


def purity_report(rows: DataFrame, purity: Column, floor: float) -> DataFrame:
    return rows.agg(F.avg(purity).alias("mean_purity"), F.avg((purity < floor).cast("double")).alias("below_floor"))


def dpo_metrics(rows: DataFrame, beta: float = 0.1) -> DataFrame:
    """Loss, accuracy and margin of preference rows with log probabilities (chosen, rejected, ref_chosen, ref_rejected)."""
    chosen = beta * (F.col("chosen") - F.col("ref_chosen"))
    rejected = beta * (F.col("rejected") - F.col("ref_rejected"))
    margin = chosen - rejected
    return rows.agg(F.avg(F.log1p(F.exp(-margin))).alias("loss"), F.avg((margin > 0).cast("double")).alias("accuracy"), F.avg(margin).alias("margin"), F.avg(chosen).alias("chosen_reward"), F.avg(rejected).alias("rejected_reward"))


def masked_mean(values: Column, mask: Column) -> Column:
    """Mean of array values where the mask is 1; an empty mask gives 0."""
    total = F.aggregate(F.zip_with(values, mask, lambda v, m: v * m), F.lit(0.0), lambda a, x: a + x)
    return total / F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, m: a + m), F.lit(1.0))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
