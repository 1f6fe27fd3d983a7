"""Token-weighted mixtures: measure sources, plan their shares, emit copies, report what came out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakecorpus.functions.hashing import uniform
from lakecorpus.functions.metrics import token_proxy

from .dedup import checkpointed


def measure(docs: DataFrame, source: str = "source", position: str = "doc_id", sample: int = 2000, tokens: Column | None = None) -> DataFrame:
    """(source, n_docs, n_chars, sample_tokens, sample_chars, est_tokens): tokens are counted on each source's first ``sample`` documents.

    The sample is the feature: counting tokens is dear. Documents and characters are counted over all.
    """
    chars = F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long")
    totals = docs.groupBy(source).agg(F.count(F.lit(1)).alias("n_docs"), chars.alias("n_chars"))
    # places are ranked without texts: of those each task sends its first of a source, and texts are read only up to the last place
    firsts = lambda d: d.withColumn("r", F.row_number().over(Window.partitionBy(source).orderBy(position))).where(F.col("r") <= sample)
    last = firsts(docs.select(source, position)).groupBy(F.col(source).alias("_of")).agg(F.max(position).alias("_last"))
    near = docs.join(F.broadcast(last), docs[source].eqNullSafe(F.col("_of")) & (F.col(position).isNull() | (F.col(position) <= F.col("_last"))))
    counted = near.select(source, position, F.length("text").alias("_chars"), (token_proxy(F.col("text")) if tokens is None else tokens).alias("_tokens"))
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sampled = firsts(counted).groupBy(source).agg(whole("_tokens").alias("sample_tokens"), whole("_chars").alias("sample_chars"))
    out = totals.join(sampled, totals[source].eqNullSafe(sampled[source])).select(totals[source], "n_docs", "n_chars", "sample_tokens", "sample_chars")
    est = F.when(F.col("sample_chars") > 0, F.bround(F.col("n_chars") * (F.col("sample_tokens") / F.col("sample_chars")))).otherwise(0)
    return out.withColumn("est_tokens", est.cast("long"))


def plan(stats: DataFrame, weights: DataFrame, source: str = "source", total_tokens: float | None = None, max_epochs: float = 4.0) -> DataFrame:
    """Adds weight, target_tokens, repeat_factor and emit_prob to measured sources.

    The budget is ``total_tokens``, or all there are. No source is repeated more than ``max_epochs`` times.
    """
    d = stats.join(weights.select(source, "weight"), source)
    total = d.agg(F.sum("weight").alias("w"), F.sum("est_tokens").alias("t")).first()
    weight, available = (total["w"] or 1.0), (total["t"] or 0)
    budget = float(total_tokens or available)
    target = F.col("weight") / F.lit(float(weight)) * F.lit(budget)
    desired = F.when(F.col("est_tokens") > 0, target / F.col("est_tokens"))
    factor = F.when(desired.isNull(), 0.0).when(desired <= 1, desired).otherwise(F.least(desired, F.lit(max_epochs)))
    d = d.withColumn("target_tokens", target).withColumn("repeat_factor", factor)
    return d.withColumn("emit_prob", F.when(F.col("repeat_factor") <= 1, F.col("repeat_factor")).otherwise(F.col("repeat_factor") / F.ceil("repeat_factor")))


def copies(factor: Column, draw: Column) -> Column:
    """Whole copies of a repeat factor; the expected number equals the factor."""
    return F.when(factor > 0, F.floor(factor) + F.when(draw < factor - F.floor(factor), 1).otherwise(0)).otherwise(0).cast("int")


def emit(docs: DataFrame, planned: DataFrame, source: str = "source", position: str = "doc_id", seed: int = 0) -> DataFrame:
    """A row for each emitted copy of each document, with ``copy``. Draws follow from (seed, position)."""
    d = docs.join(planned.select(source, "repeat_factor"), source)
    n = copies(F.col("repeat_factor"), uniform(F.lit(str(seed)), F.col(position).cast("string")))
    return d.withColumn("_n", n).where(F.col("_n") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n", "repeat_factor")


def shuffled(rows: DataFrame, seed: int = 0, *keys: str) -> DataFrame:
    """A global order that follows from the seed and the keys: a full mix, in range partitions."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *keys), *keys)


def numbered_within(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Adds turn, from 1: the place of each row among those of its key by position.

    Rows are sorted by key and position over all tasks, so a common key fills many; places are counted from the first of each key in each of them.
    """
    placed = checkpointed(rows.orderBy(key, position).withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    runs = placed.groupBy(key, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # a row for each key in each part of the sort
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col(key).alias("_key"), F.col("_part").alias("_p"), "_first", before.alias("_before"))
    joined = placed.join(runs, placed[key].eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")))
    return joined.select(*[placed[c] for c in rows.columns], (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("turn"))


def interleave(rows: DataFrame, source: str = "source", position: str = "doc_id") -> DataFrame:
    """Adds turn: the order in which sources take turns, each by position."""
    return numbered_within(rows, source, position)


def report(emitted: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_docs, n_tokens, share of all tokens) of what was emitted."""
    each = emitted.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(token_proxy(F.col("text"))).alias("n_tokens"))
    return each.withColumn("share", F.col("n_tokens") / F.sum("n_tokens").over(Window.partitionBy()))


def capped_seed(docs: DataFrame, domain: Column, per_domain: int = 2000, key_chars: int = 120, position: str = "doc_id") -> DataFrame:
    """The first ``per_domain`` documents of each domain in the order of their positions, with rank. Null domains go.

    A document whose first characters one before it had is left out and doesn't count; but only documents that were taken stand for
    their characters: one that came when its domain was full doesn't. Where each domain fills up is found in rounds; a round can
    only bring places forward, and what is kept of it is one place for each domain.
    """
    d = docs.withColumn("domain", domain).where(F.col("domain").isNotNull())
    keyed = checkpointed(d.select(position, "domain", F.xxhash64(F.substring("text", 1, key_chars)).alias("_k1"), F.sha1(F.substring("text", 1, key_chars).cast("binary")).alias("_k2")))
    full: dict[str, int] = {}
    while True:
        open_ = F.lit(True)
        for name, at in full.items():
            open_ = open_ & ((F.col("domain") != name) | (F.col(position) <= F.lit(at)))
        firsts = keyed.where(open_).groupBy("_k1", "_k2").agg(F.min_by(F.struct(position, "domain"), position).alias("f")).select("f.*")
        ranked = firsts.withColumn("rank", F.row_number().over(Window.partitionBy("domain").orderBy(position))).where(F.col("rank") <= per_domain)
        ranked = checkpointed(ranked)
        now = {r["domain"]: r[position] for r in ranked.where(F.col("rank") == per_domain).collect()}  # one row a domain
        if now == full:
            return d.drop("domain").join(ranked, position)
        full = now


#: Keywords of domains, in the order in which they are tried (fixed values).
DOMAIN_KEYWORDS = {
    "philosophy": ("哲学", "逻辑", "伦理", "形而上", "认识论", "辩证", "本体论"),
    "math": ("数学", "代数", "几何", "微积分", "概率", "拓扑", "方程", "函数", "定理"),
    "physics": ("物理", "力学", "量子", "热力学", "电磁", "相对论", "粒子", "光学"),
    "chemistry": ("化学", "分子", "化合物", "反应", "催化", "有机", "无机", "电化学"),
    "science": ("科学", "工程", "算法", "实验", "理论", "模型", "推理", "证明"),
}


def classify(text: Column, keywords: dict[str, tuple[str, ...]] = DOMAIN_KEYWORDS) -> Column:
    """The first domain with a keyword in the text; null if there is none."""
    out = None
    for domain, words in keywords.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w)
        out = F.when(hit, domain) if out is None else out.when(hit, domain)
    return out


def classify_record(meta: Column, abstract: Column, keywords: dict[str, tuple[str, ...]] = DOMAIN_KEYWORDS) -> Column:
    """By the record's metadata first, then by its abstract."""
    return F.coalesce(classify(meta, keywords), classify(abstract, keywords))
