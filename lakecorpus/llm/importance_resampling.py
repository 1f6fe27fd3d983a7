"""Importance resampling towards a target distribution, over hashed runs of one to three words.

A byte-automaton reads the UTF-8 buffers of Arrow batches: a table of 256 entries classifies every byte, differences of the classes are
the word boundaries, and table-driven CRCs advance over the bytes of all words at the same time, one byte of each word a step. The CRC of
a run of words goes on from the one of the run before its last word, so each word is stepped through three times: alone, behind one word, and behind two.

Counts of the buckets are added up in each task before they are shuffled: a task sends one row a bucket, whatever it reads.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, row

#: Words of a run at most.
RUN = 3
#: Bytes that are read at once; a word is never parted.
BLOCK = 1 << 18
#: Longer words are taken by ``zlib``, one after the other, as they would leave few words to step through at the same time.
LONG_WORD = 64
_FULL = np.uint32(0xFFFFFFFF)


@dataclass(frozen=True)
class ResamplingConfig:
    buckets: int = 10_000
    #: Fewest words of a document that can be drawn.
    least_words: int = 20
    #: Share of those that are drawn, in hundredths.
    percent: int = 5
    seed: int = 42


def _crc_table() -> np.ndarray:
    """The table of the reflected CRC-32: eight shifts of each byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_TABLE = _crc_table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: True for what stands in words once A-Z are in lower case: digits, letters and all bytes of other characters.
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[0x30:0x3A] = _IN_WORD[0x41:0x5B] = _IN_WORD[0x61:0x7B] = _IN_WORD[0x80:] = True
_SPACE = np.uint8(32)


def _step(state: np.ndarray, byte: np.ndarray | np.uint8) -> np.ndarray:
    return _TABLE[(state ^ byte).astype(np.uint8)] ^ (state >> np.uint32(8))


class _Words:
    """The words of a block: where they begin, how long they are, and the bytes that each step takes."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.data, self.starts, self.sizes = data, starts, sizes
        self.long = np.flatnonzero(sizes > LONG_WORD)
        short = np.where(sizes > LONG_WORD, 0, sizes).astype(np.int16)
        self.order = np.argsort(-short, kind="stable")
        active = len(sizes) - np.cumsum(np.bincount(short, minlength=1))  # words of over 0, 1, 2... bytes
        first = starts[self.order]
        self.columns = [(m, data[first[:m] + k]) for k, m in enumerate(active[:-1].tolist())]

    def advance(self, state: np.ndarray) -> np.ndarray:
        """The states behind each word, from those in front of it."""
        s = state[self.order]
        for m, byte in self.columns:
            s[:m] = _step(s[:m], byte)
        out = np.empty_like(s)
        out[self.order] = s
        for i in self.long.tolist():
            word = self.data[self.starts[i] : self.starts[i] + self.sizes[i]]
            out[i] = zlib.crc32(word, int(state[i] ^ _FULL)) ^ 0xFFFFFFFF
        return out


def runs(texts: pa.Array, each: Callable[[np.ndarray, np.ndarray, np.ndarray], None], longest: int = RUN) -> None:
    """Calls ``each`` for each block with the documents of its words, the CRCs of the runs that end with them (a row for each length), and which of them there are."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, values = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    base, size = int(at[0]), int(at[-1] - at[0])
    if not size:
        return
    at = at - base
    raw = np.frombuffer(values, dtype=np.uint8)[base : base + size]
    # the last word of the block before: its document, the words of that in front, and its states
    last_doc, before = -1, np.zeros(longest - 1, dtype=np.uint32)
    there = np.zeros(longest - 1, dtype=bool)
    begin = 0
    while begin < size:
        end = min(begin + BLOCK, size)
        while end < size and _IN_WORD[raw[end - 1]]:  # on to the end of the word
            ahead = np.flatnonzero(~_IN_WORD[raw[end : end + BLOCK]])
            end = min(end + (int(ahead[0]) + 1 if len(ahead) else BLOCK), size)
        data = _LOWER[raw[begin:end]]
        inside = np.zeros(end - begin + 2, dtype=bool)
        inside[1:-1] = _IN_WORD[data]
        first = inside[1:] & ~inside[:-1]
        past = inside[:-1] & ~inside[1:]
        # a text that begins in the block parts words, too
        cuts = at[np.searchsorted(at, begin, side="right") : np.searchsorted(at, end)] - begin
        both = cuts[inside[cuts] & inside[cuts + 1]]
        first[both] = past[both] = True
        starts = np.flatnonzero(first)
        if len(starts):
            sizes = np.flatnonzero(past) - starts
            docs = np.searchsorted(at, starts + begin, side="right") - 1
            words = _Words(data, starts, sizes)
            n = len(starts)
            states = np.empty((longest, n), dtype=np.uint32)
            valid = np.ones((longest, n), dtype=bool)
            same = docs == np.r_[last_doc, docs[:-1]]
            states[0] = words.advance(np.full(n, _FULL))
            for k in range(1, longest):
                front = np.r_[before[k - 1], states[k - 1, :-1]]
                states[k] = words.advance(_step(front, _SPACE))
                valid[k] = same & np.r_[there[k - 1], valid[k - 1, :-1]]
            last_doc, before, there = int(docs[-1]), states[:-1, -1].copy(), valid[:-1, -1].copy()
            each(docs, states ^ _FULL, valid)
        begin = end


def bucket_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n): how many runs of one to three words of all texts fall into each bucket. Buckets without any have no row; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)

        def each(_, crc, valid):
            nonlocal total
            total += np.bincount(crc[valid] % np.uint32(buckets), minlength=buckets)

        for batch in batches:
            runs(batch.column("text"), each)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["bucket", "n"])

    return docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket from the counts of both: a thousand times the logarithm of how much commoner it is in the target, each count one higher."""
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    whole = Window.partitionBy()  # ``buckets`` rows
    d = lambda c: c.cast("double")
    s, t = d(F.col("s") + 1), d(F.col("t") + 1)
    ratio = t * d(F.sum("s").over(whole) + buckets) / (s * d(F.sum("t").over(whole) + buckets))
    return both.select("bucket", F.floor(1000.0 * F.ln(ratio)).alias("gain"))


def weigh(docs: DataFrame, gains: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with n_words, n_features and weight, the sum of the gains of a document's runs. The gains are collected: one number a bucket."""
    rows = gains.collect()
    table = np.zeros(len(rows))
    table[[r.bucket for r in rows]] = [r.gain for r in rows]
    buckets = np.uint32(len(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            words, weight = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)

            def each(docs, crc, valid):
                nonlocal words, weight
                gain = np.where(valid, table[crc % buckets], 0.0).sum(axis=0)
                words += np.bincount(docs, minlength=n)
                weight += np.bincount(docs, weights=gain, minlength=n).astype(np.int64)  # whole numbers, exact in doubles

            runs(batch.column("_text"), each)
            features = sum(np.maximum(words - k, 0) for k in range(RUN))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(words), pa.array(features), pa.array(weight)], names=["_row", "n_words", "n_features", "weight"])

    kept = row(docs.select(*keep))
    schema = docs.select(kept).schema.add("n_words", "long").add("n_features", "long").add("weight", "long")
    return docs.select(kept, F.col("text").alias("_text")).mapInArrow(run, schema)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the id alone; a null id is hashed as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, config: ResamplingConfig = ResamplingConfig(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of every document with n_features, weight, score and rank: 1, 2, 3... for those drawn in falling order of score, else null.

    ``keep`` has doc_id in it, to which ties go in rising order (null last); of equal ids any is first. Null and empty texts have no features, weight 0, and are never drawn.
    Repeated rows count as often as they occur and may be drawn as often. Where the target is empty, weights still follow from the counts with one added. An empty table gives an empty result.

    Ranks come from a range sort and the counts of the partitions before: no task holds all rows.
    """
    gains = bucket_gains(bucket_counts(docs, config.buckets), bucket_counts(target, config.buckets), config.buckets)
    doc_id = F.col("_row.doc_id")
    weighed = weigh(docs, gains, keep).withColumns({"score": F.col("weight") + noise(doc_id, config.seed), "_able": F.col("n_words") >= config.least_words})
    weighed = cut(weighed.drop("n_words"), "resampling-weights")
    placed = cut(weighed.orderBy(F.desc("_able"), F.desc("score"), F.asc_nulls_last("_row.doc_id")).withColumn("_at", F.monotonically_increasing_id()), "resampling-order")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.count(F.when(F.col("_able"), 1)).alias("_able_n"))
    # a row for each partition of the sort
    front = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    drawn = F.floor(F.sum("_able_n").over(Window.partitionBy()) * config.percent / 100)
    starts = sizes.select("_part", front.alias("_front"), drawn.alias("_drawn"))
    rank = F.col("_front") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    out = placed.withColumn("_part", part).join(starts, "_part")
    return out.select("_row.*", "n_features", "weight", "score", F.when(rank <= F.col("_drawn"), rank).alias("rank"))
