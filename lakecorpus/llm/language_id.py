"""Language identification by rank-order n-gram profiles.

The most frequent n-grams (1 to 5 letters, words padded by ``_``) of all training texts of a language,
in order of frequency, are its profile. A document's own most frequent n-grams are compared to
each profile by the out-of-place distance: the sum of the differences of ranks, with the greatest
difference for an n-gram that the profile lacks. The least distance wins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Documents whose n-grams are counted together; the keys below leave 8 bits for it.
ROWS = 256
_LETTERS = regex.compile(r"\p{L}{1,40}")
_MASK = np.uint64((1 << 56) - 1)


@dataclass(frozen=True)
class ProfileConfig:
    profile_size: int = 400
    document_size: int = 300
    longest: int = 5
    #: Parts that a language's n-grams are dealt to before its most frequent ones are picked.
    parts: int = 64


def train_profiles(docs: DataFrame, config: ProfileConfig = ProfileConfig()) -> DataFrame:
    """(lang, gram, rank): the profile of each language, from all rows with text and lang.

    Words are counted first and n-grams taken from distinct words, weighted. Runs of over 40 letters
    are taken in pieces of 40. Ties of frequency go by the n-gram. The result has
    ``profile_size`` rows a language at most. No rows give no profiles.
    """
    words = (
        docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
        .select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{1,40}"), F.lit(0))).alias("word"))
        .groupBy("lang", "word")
        .count()
    )
    padded = F.concat(F.lit("_"), "word", F.lit("_"))

    def of_length(n: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), lambda i: F.substring(padded, i, F.lit(n)))
        return F.when(F.length(padded) >= n, runs).otherwise(F.array().cast("array<string>"))

    every = F.concat(*[of_length(n) for n in range(1, config.longest + 1)])
    grams = words.select("lang", "count", F.explode(every).alias("gram")).groupBy("lang", "gram").agg(F.sum("count").alias("n"))
    order = [F.desc("n"), F.asc("gram")]
    part = F.pmod(F.xxhash64("gram"), F.lit(config.parts))
    first = grams.withColumn("_r", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("_r") <= config.profile_size)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)) - 1)
    return ranked.where(F.col("rank") < config.profile_size).select("lang", "gram", "rank")


def _hashes(padded: list[str], longest: int) -> tuple[np.ndarray, np.ndarray]:
    """56-bit keys of all n-grams of ``padded`` words, and the word that each is of."""
    sizes = np.fromiter(map(len, padded), dtype=np.int64, count=len(padded))
    code = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(padded)), sizes)
    keys, owners = [], []
    h = np.zeros(len(code), dtype=np.uint64)
    for n in range(1, longest + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        h = (h[:m] ^ (code[n - 1 :] + np.uint64(n << 32))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        inside = word[:m] == word[n - 1 :]
        keys.append(h[inside])
        owners.append(word[:m][inside])
    return np.concatenate(keys) & _MASK, np.concatenate(owners)


def _gram_keys(grams: list[str], longest: int) -> np.ndarray:
    out = np.zeros(len(grams), dtype=np.uint64)
    for n in range(1, longest + 1):
        at = [i for i, g in enumerate(grams) if len(g) == n]
        if at:
            keys, owners = _hashes([grams[i] for i in at], longest)
            out[at] = keys[-len(at) :]  # the longest n-gram of each is itself
    return out


class Profiles:
    """Profiles as arrays: a row for each n-gram of any profile, a column for each language."""

    def __init__(self, rows: list[tuple[str, str, int]], config: ProfileConfig):
        self.config = config
        self.langs = sorted({r[0] for r in rows})
        column = {x: k for k, x in enumerate(self.langs)}
        keys = _gram_keys([r[1] for r in rows], config.longest)
        self.keys, at = np.unique(keys, return_inverse=True)
        self.ranks = np.full((len(self.keys), len(self.langs)), -1, dtype=np.int64)
        for i, (lang, _, rank) in zip(at, rows, strict=True):
            self.ranks[i, column[lang]] = rank

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of up to ROWS texts. N-grams of a document with equal counts stand in the order of 32 bits of their hashes; counts of over 2^24 - 1 are equal."""
        c = self.config
        counts = [Counter(_LETTERS.findall(t.lower())) if t else Counter() for t in texts]
        padded = [f"_{w}_" for x in counts for w in x]
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not padded or not self.langs:
            return langs, scores
        doc_of_word = np.repeat(np.arange(len(texts)), [len(x) for x in counts])
        weight = np.fromiter((n for x in counts for n in x.values()), dtype=np.int64, count=len(padded))
        keys, owners = _hashes(padded, c.longest)
        full = (doc_of_word[owners].astype(np.uint64) << np.uint64(56)) | keys
        order = np.argsort(full)
        full = full[order]
        begins = np.flatnonzero(np.r_[True, full[1:] != full[:-1]])
        n = np.add.reduceat(weight[owners[order]], begins)
        full = full[begins]
        # by document, falling count, key
        fall = np.uint64((1 << 24) - 1) - np.minimum(n, (1 << 24) - 1).astype(np.uint64)
        order = np.argsort((full & ~_MASK) | (fall << np.uint64(32)) | ((full & _MASK) >> np.uint64(24)))
        full = full[order]
        doc = (full >> np.uint64(56)).astype(np.int64)
        begins = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        rank = np.arange(len(doc)) - np.repeat(begins, np.diff(np.r_[begins, len(doc)]))
        used = rank < c.document_size
        doc, rank, key = doc[used], rank[used], full[used] & _MASK
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        theirs = np.where((self.keys[at] == key)[:, None], self.ranks[at], -1)
        apart = np.where(theirs < 0, c.profile_size, np.minimum(np.abs(theirs - rank[:, None]), c.profile_size))
        begins = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        total = np.add.reduceat(apart, begins, axis=0)
        most = np.diff(np.r_[begins, len(doc)]) * c.profile_size
        best = total.argmin(axis=1)
        for d, b, t, m in zip(doc[begins], best, total, most, strict=True):
            langs[d], scores[d] = self.langs[b], float(1 - t[b] / m)
        return langs, scores


def identify(docs: DataFrame, profiles: DataFrame, config: ProfileConfig = ProfileConfig(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of each row with lang_pred and score (1 less the share of the greatest distance).

    The profiles are collected: a fixed number of rows a language. Only the text is looked at. A null text or one without a letter gives
    ``und`` and 0; so does any text where there are no profiles. Ties go to the first language in
    order. Repeated rows are judged alike; an empty table gives an empty result.
    """
    model = Profiles([(r.lang, r.gram, r.rank) for r in profiles.collect()], config)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                langs, scores = model.predict(part.column("text").to_pylist())
                cols = [part.column(k) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(langs, type=pa.string()), pa.array(scores, type=pa.float64())], names=[*keep, "lang_pred", "score"])

    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*keep, "text").mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """True for the third of the documents that nothing is learned from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
