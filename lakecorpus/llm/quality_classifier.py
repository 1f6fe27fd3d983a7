"""Quality classifier by pairwise ranking (Bradley-Terry).

A document has a latent score, linear in features of its text. Each pair of a good and a bad document is a preference, won with a chance that is logistic in the difference of the two scores.
The likelihood is maximal where Newton's steps end. The labelled documents lie in blocks; in a block all its good documents are held against all its bad ones, and what a step
needs of those pairs (gradient and curvature) follows from products of matrices, without a pair being made. Each task adds up its blocks and sends one row.

The latent score is then cut at a quantile: the share of bad documents among those learned from. Scores are logistic in the distance to it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import all_columns, cut, row
from .importance_resampling import runs

#: What a byte counts as, besides being a character or not.
_SYMBOLS, _CRIES, _ENDS, _COMMAS, _DIGITS, _BREAKS = b"#*$%&|<>~^=_@`{}[]\\+", b"!?", b".!?", b",;:", b"0123456789", b"\n"
#: Bytes of texts whose features are made together.
PART = 1 << 22


@dataclass(frozen=True)
class RankingConfig:
    #: Labelled rows that are learned from at most (in expectation: ids are drawn by hash); all of them by default.
    most_labelled: int | None = None
    #: Documents of a block, in which all pairs count.
    block: int = 256
    #: Tasks that a step is dealt to at least, and rows of a task.
    parts: int = 16
    rows: int = 50_000
    steps: int = 25
    #: Weight of the squared coefficients, as a share of the pairs.
    ridge: float = 1e-4
    #: The score at the quantile.
    threshold: float = 0.3


def _mask(which: bytes) -> np.ndarray:
    m = np.zeros(256, dtype=np.uint8)
    m[list(which)] = 1
    return m


_MASKS = [_mask(b) for b in (_SYMBOLS, _CRIES, _ENDS, _COMMAS, _DIGITS, _BREAKS, bytes([*range(0x80), *range(0xC0, 0x100)]))]
N_FEATURES = 12


def _features(texts: pa.Array) -> np.ndarray:
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    _, offsets, values = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    there = np.flatnonzero(np.diff(at))
    counts = np.zeros((len(_MASKS), n))
    if len(there):
        raw = np.frombuffer(values, dtype=np.uint8)[at[0] : at[-1]]
        for k, m in enumerate(_MASKS):
            counts[k, there] = np.add.reduceat(m[raw], at[there] - at[0], dtype=np.int64)
    symbols, cries, ends, commas, digits, breaks, chars = counts
    capitals = pc.count_substring_regex(texts, r"\p{Lu}").to_numpy(zero_copy_only=False).astype(float)
    repeated = np.array([len(x) - len(set(x)) for x in (t.split("\n") for t in texts.to_pylist())], dtype=float)
    words, stutters = np.zeros(n), np.zeros(n)
    last = (-1, 0)

    def each(docs, crc, _):
        nonlocal words, stutters, last
        crc = crc[0]
        again = (docs == np.r_[last[0], docs[:-1]]) & (crc == np.r_[np.uint32(last[1]), crc[:-1]])
        words += np.bincount(docs, minlength=n)
        stutters += np.bincount(docs[again], minlength=n)
        last = int(docs[-1]), int(crc[-1])

    runs(texts, each, longest=1)
    shouted = np.maximum(capitals - ends - breaks - 1, 0)  # one capital a sentence and line is no shouting
    c, w = chars + 20, words + 5
    columns = [np.sqrt(symbols / c), np.sqrt(cries / c), np.sqrt(shouted / c), np.sqrt(digits / c), ends / w, commas / w, np.sqrt(stutters / w), np.sqrt(repeated / (breaks + 3)), np.minimum(chars / w, 30), np.log1p(words), 1 / (1 + words), breaks / c]
    return np.stack(columns, axis=1)


def features(docs: DataFrame) -> DataFrame:
    """``docs`` without text, with features: an array of doubles made from the text alone. A null text is an empty one."""
    others = [c for c, name in zip(all_columns(docs), docs.columns, strict=True) if name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("_text")), 0).to_numpy(zero_copy_only=False)
            part = np.cumsum(sizes, dtype=np.int64) // PART
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                x = _features(batch.column("_text").slice(a, b - a))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * N_FEATURES), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("_row").slice(a, b - a), lists], names=["_row", "features"])

    kept = row(docs.select(*others))
    made = docs.select(kept, F.col("text").alias("_text")).mapInArrow(run, docs.select(kept).schema.add("features", ArrayType(DoubleType())))
    return made.select("_row.*", "features")


@dataclass(frozen=True)
class Ranking:
    """Latent score: ``weights`` on standardised features. ``quantile`` is the latent score that ``threshold`` stands for."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    quantile: float = 0.0

    def latent(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), width)


def _step_of(batches: Iterator[pa.RecordBatch], model: Ranking, block: int) -> Iterator[pa.RecordBatch]:
    """One row: the number of pairs of a task's blocks, the gradient of their loss and its curvature."""
    d = len(model.weights)
    pairs, gradient, curvature = 0, np.zeros(d), np.zeros((d, d))
    left: list[tuple[np.ndarray, np.ndarray]] = []

    def add(x: np.ndarray, good: np.ndarray):
        nonlocal pairs, gradient, curvature
        x = (x - model.mean) / model.scale
        a, b = x[good], x[~good]
        margin = (a @ model.weights)[:, None] - (b @ model.weights)[None, :]
        lose = 1 / (1 + np.exp(np.clip(margin, -500, 500)))
        bend = lose * (1 - lose)
        pairs += margin.size
        gradient -= lose.sum(1) @ a - lose.sum(0) @ b
        mixed = a.T @ bend @ b
        curvature += (a.T * bend.sum(1)) @ a + (b.T * bend.sum(0)) @ b - mixed - mixed.T

    for batch in batches:
        left.append((_matrix(batch.column("features"), d), batch.column("good").to_numpy(zero_copy_only=False).astype(bool)))
        if sum(len(g) for _, g in left) >= block:
            x, good = (np.concatenate(c) for c in zip(*left, strict=True))
            whole = len(good) // block * block
            for k in range(0, whole, block):
                add(x[k : k + block], good[k : k + block])
            left = [(x[whole:], good[whole:])]
    if left:
        add(*(np.concatenate(c) for c in zip(*left, strict=True)))
    flat = np.r_[pairs, gradient, curvature.ravel()]
    yield pa.RecordBatch.from_arrays([pa.array([flat.tolist()], type=pa.list_(pa.float64()))], names=["sums"])


def train(labelled: DataFrame, config: RankingConfig = RankingConfig()) -> Ranking | None:
    """The ranking learned from all rows (key, features, good). None where there aren't both good and bad documents.

    Rows lie in blocks in the order of the hash of key, so a block has its share of both; rows of a null key, features or good are left out.
    """
    rows = labelled.where(F.col("key").isNotNull() & F.col("features").isNotNull() & F.col("good").isNotNull())
    order = F.xxhash64(F.col("key"), F.lit(1))
    kept = cut(rows.select("features", "good", order.alias("h")), "labelled")
    parts = max(config.parts, -(-kept.count() // config.rows))
    dealt = cut(kept.repartition(parts, "h").sortWithinPartitions("h", "good", "features"), "ranking-rows")
    # moments of each feature: an array has a fixed number of them
    each = dealt.select("good", F.posexplode("features").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("scale"), F.count(F.lit(1)).alias("n"), F.sum(F.col("good").cast("long")).alias("n_good")).orderBy("k").collect()
    if not each or each[0].n_good in (0, each[0].n):
        return None
    mean, scale = np.array([r.mean for r in each]), np.array([r.scale or 1.0 for r in each])
    model = Ranking(mean, np.where(scale > 1e-12, scale, 1.0), np.zeros(len(each)))
    for _ in range(config.steps):
        sent = dealt.select("features", "good").mapInArrow(lambda b, m=model: _step_of(b, m, config.block), "sums array<double>").collect()
        total = np.sum(sorted(r.sums for r in sent), axis=0)
        pairs, d = max(total[0], 1.0), len(model.weights)
        gradient = total[1 : d + 1] / pairs + config.ridge * model.weights
        curvature = total[d + 1 :].reshape(d, d) / pairs + config.ridge * np.eye(d)
        change = np.linalg.solve(curvature, gradient)
        change *= min(1.0, 5.0 / max(np.abs(change).max(), 1e-300))  # far from the end a whole step can lead astray
        model = Ranking(model.mean, model.scale, model.weights - change)
        if np.abs(change).max() < 1e-6:
            break
    bad, n = each[0].n - each[0].n_good, each[0].n
    level = (bad - 0.5) / max(n - 1, 1)
    at = quantile(scored(dealt, model).select("latent"), min(max(level, 0.0), 1.0))
    return Ranking(model.mean, model.scale, model.weights, at)


#: Bins of a histogram, and the values that are few enough to be looked at one by one.
BINS, FEW = 4096, 10_000


def _ordered(values: DataFrame, place: int) -> float:
    """The value at a place, from 0, in the order of all: histograms narrow the range down until few values are left in it. No task holds more than a histogram or those few."""
    low, high, n = values.agg(F.min("latent"), F.max("latent"), F.count("latent")).first()
    while n > FEW and low < high:
        width = (high - low) / BINS
        k = F.least(F.floor((F.col("latent") - F.lit(low)) / F.lit(width)), F.lit(BINS - 1))
        bins = values.where(F.col("latent").between(low, high)).groupBy(k.alias("k")).agg(F.min("latent").alias("low"), F.max("latent").alias("high"), F.count(F.lit(1)).alias("n")).orderBy("k").collect()
        for b in bins:
            if place < b.n:
                break
            place -= b.n
        low, high, n = b.low, b.high, b.n
    if low == high:
        return low
    return sorted(r.latent for r in values.where(F.col("latent").between(low, high)).collect())[place]


def quantile(values: DataFrame, level: float) -> float:
    """The exact quantile of latent, between the two values next to it as ``percentile`` has it, over all rows."""
    at = level * (values.count() - 1)
    below = math.floor(at)
    a, b = _ordered(values, below), _ordered(values, math.ceil(at))
    return a if a == b else (below + 1 - at) * a + (at - below) * b


def scored(rows: DataFrame, model: Ranking) -> DataFrame:
    """Adds latent, the latent score, to rows with features."""
    parts = [(F.element_at("features", k + 1) - float(m)) / float(s) * float(w) for k, (m, s, w) in enumerate(zip(model.mean, model.scale, model.weights, strict=True))]
    return rows.withColumn("latent", sum(parts[1:], parts[0]))


def classify(docs: DataFrame, model: Ranking | None, config: RankingConfig = RankingConfig(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of each row with score (0 to 1, higher for better texts) and predicted (1 from the threshold on, else 0).

    Only the text is looked at; a null text is an empty one and is scored as such. Without a model all scores are 0.5. Repeated rows are judged alike; an empty table gives an empty result.
    """
    kept = docs.select(row(docs.select(*keep)).alias("_kept"), "text")
    if model is None:
        score = kept.select("_kept", F.lit(0.5).alias("_score"))
    else:
        odds = F.lit(math.log(config.threshold / (1 - config.threshold))) + F.col("latent") - F.lit(model.quantile)
        score = scored(features(kept), model).select("_kept", (1 / (1 + F.exp(-odds))).alias("_score"))
    return score.select("_kept.*", F.col("_score").alias("score"), F.when(F.col("_score") >= config.threshold, 1).otherwise(0).alias("predicted"))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that nothing is learned from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample_labelled(docs: DataFrame, labels: DataFrame, config: RankingConfig = RankingConfig()) -> DataFrame:
    """(key, features, good) of documents (doc_id, text) with a label (doc_id, quality), those of ids that are held out left out.

    All are learned from, unless ``most_labelled`` asks for fewer: then ids are drawn by hash, from both tables, before any text is looked at. Only features are shuffled. A document with two labels is there twice.
    Quality 1 is good, any other bad; null labels don't count.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("key"), (F.col("quality") == 1).alias("good"))
    n = known.count() if config.most_labelled is not None else 0
    bound = 1 << 30 if config.most_labelled is None or n <= config.most_labelled else int((1 << 30) * config.most_labelled / n)
    drawn = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 30)) < bound
    texts = docs.where(~held_out(F.col("doc_id")) & drawn("doc_id")).select(F.col("doc_id").alias("key"), "text")
    return features(texts).join(known.where(drawn("key")), "key").select("key", "features", "good")
