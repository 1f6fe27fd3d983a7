"""Removal of repeated byte strings across documents by column-wise construction over a collection.

Building the transform of whole documents column by column takes as many rounds over all data as the longest document has bytes. So
documents are cut at content-defined anchors first: each string of ``length`` bytes has one anchor, the leftmost least
hash of its k-grams, so equal strings have equal anchors at equal offsets. All strings of one document that share an
anchor are one piece. Anchors that occur once in the corpus are dropped; nothing can match there.

The pieces of a bucket are aligned at their anchors. From the last column to the first, each round inserts one symbol of
every piece: a stable sort of the column permuted by the present order (the column's Burrows-Wheeler transform) gives the order of the
longer suffixes, and the common prefixes of neighbours follow from range minima of the old ones. The columns lie in
one sequential file of the task, read backwards. Neighbours with a common prefix of ``length`` are the same string; all
but the earliest are marked. Which strings match is decided on the bytes; hashes only deal them out.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import cut

_POSITION = 26
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(21).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class SuffixConfig:
    length: int = 100
    #: Bytes of an anchor's k-gram: 24 or a power of two below ``length``.
    gram: int = 24
    #: Bytes of documents that are searched for anchors at once; below 2 ** 26.
    stretch: int = 8 << 20
    #: Pieces of one anchor in one bucket; what is left of more common anchors meets once more by string.
    bucket: int = 50_000

    @property
    def window(self) -> int:
        return self.length - self.gram + 1


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    def joined(a, b, n):
        h = (a[: len(b)] + np.uint64(n)) * _MIX
        h ^= h >> np.uint64(32)
        h += b
        h *= _MIX
        return h

    h, n, eight = _TABLE[data], 1, None
    while n * 2 <= gram:
        if n == 8:
            eight = h
        h, n = joined(h, h[n:], n), n * 2
    return joined(h, eight[16:], 16) if n < gram else h


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row."""
    n = 1
    while n * 2 <= width:
        v, n = np.minimum(v[: len(v) - n], v[n:]), n * 2
    return np.minimum(v[: len(v) - (width - n)], v[width - n :]) if n < width else v


def anchors(texts: list[bytes], c: SuffixConfig) -> tuple[np.ndarray, ...]:
    """Pieces of documents: document, hash of the anchor, first start, offset of the anchor behind it, number of starts."""
    none = (np.zeros(0, dtype=np.int64),) * 5
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if len(data) < c.length:
        return none
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    h = _gram_hashes(data, c.gram)
    mask = np.uint64((1 << _POSITION) - 1)
    least = _least((h & ~mask) | np.arange(len(h), dtype=np.uint64), c.window)
    at = (least & mask).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)[: len(at)]
    start = np.flatnonzero(np.arange(len(at)) + c.length <= (begin + sizes)[doc])
    if not len(start):
        return none
    a = at[start]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (start[1:] != start[:-1] + 1)])
    n = np.diff(np.r_[first, len(start)])
    p, a = start[first], a[first]
    d = doc[p]
    return d, h[a].view(np.int64), p - begin[d], a - p, n


def _stretches(batch: pa.RecordBatch, c: SuffixConfig) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Rows, offsets and bytes of documents, some at a time; longer documents in parts that overlap by a string."""
    rows, offsets, parts, size = [], [], [], 0
    for k, text in enumerate(batch.column("text")):
        data = text.as_buffer().to_pybytes() if text.is_valid else b""
        for at in range(0, max(1, len(data) - c.length + 1), c.stretch):
            part = data[at : at + c.stretch + c.length - 1]
            if size + len(part) > c.stretch + c.length and parts:
                yield rows, offsets, parts
                rows, offsets, parts, size = [], [], [], 0
            rows.append(k)
            offsets.append(at)
            parts.append(part)
            size += len(part)
    if parts:
        yield rows, offsets, parts


def _locate(batches: Iterator[pa.RecordBatch], c: SuffixConfig) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        th = batch.column("th").to_numpy()
        for rows, offsets, parts in _stretches(batch, c):
            d, h, p, off, n = anchors(parts, c)
            p = p + np.array(offsets, dtype=np.int64)[d]
            q = (p << 16) | (off << 8) | n
            for at in range(0, len(h), 100_000):
                s = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(h[s]), pa.array(th[np.array(rows)[d[s]]]), pa.array(q[s])], names=["h", "th", "q"])


def _repeated(batches: Iterator[pa.RecordBatch], c: SuffixConfig) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (h, th, q), those whose h has more than one place; ``part`` numbers the buckets of a common h."""
    held, seen = np.zeros((0, 3), dtype=np.int64), 0  # the last row, and how many of its h came before it

    def out(rows: np.ndarray, index: np.ndarray, keep: np.ndarray) -> pa.RecordBatch:
        r = rows[keep]
        return pa.RecordBatch.from_arrays([pa.array(r[:, 0]), pa.array(index[keep] // c.bucket), pa.array(r[:, 1]), pa.array(r[:, 2])], names=["h", "part", "th", "q"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.concatenate([held, np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)])
        rows = rows[np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)]]  # copies of a text have the same places
        same = rows[1:, 0] == rows[:-1, 0]
        first = np.flatnonzero(np.r_[True, ~same])
        size = np.diff(np.r_[first, len(rows)])
        index = np.arange(len(rows)) - np.repeat(first, size)
        index[: size[0]] += seen
        keep = np.r_[seen > 0, same] | np.r_[same, False]
        keep[-1] = False
        held, seen = rows[-1:], int(index[-1])
        yield out(rows, index, keep)
    if len(held) and seen:
        yield out(held, np.array([seen]), np.array([True]))


def _pieces(batches: Iterator[pa.RecordBatch], c: SuffixConfig) -> Iterator[pa.RecordBatch]:
    """The bytes of the pieces at the places of each document."""
    for batch in batches:
        h, part, q, owner, data = [], [], [], [], []
        for k, text in enumerate(batch.column("text")):
            text = text.as_buffer()
            places = batch.column("places")[k].values
            mine = places.field("q").to_numpy()
            h.append(places.field("h").to_numpy())
            part.append(places.field("part").to_numpy())
            q.append(mine)
            owner.append(np.full(len(mine), k))
            view = memoryview(text)
            for p, n in zip((mine >> 16).tolist(), (mine & 255).tolist(), strict=True):
                data.append(bytes(view[p : p + n + c.length - 1]))
        h, part, q, owner = (np.concatenate(x) for x in (h, part, q, owner))
        own = pa.array(owner)
        columns = [pa.array(h), pa.array(part), batch.column("none").take(own), batch.column("doc").take(own), batch.column("th").take(own), pa.array(q), pa.array(data, type=pa.binary())]
        whole = pa.RecordBatch.from_arrays(columns, names=["h", "part", "none", "doc", "th", "q", "s"])
        for at in range(0, len(h), 20_000):
            yield whole.slice(at, 20_000)


def mark_repeats(data: list[bytes], offset: np.ndarray, starts: np.ndarray, rank: np.ndarray, c: SuffixConfig) -> np.ndarray:
    """For each piece and offset of the anchor, whether the string that starts there also starts in a piece of smaller rank.

    ``offset``: bytes from a piece's beginning to its anchor; ``starts``: how many strings start in it, from its beginning.
    """
    m, width = len(data), c.window + c.length - 1
    sizes = np.array([len(x) for x in data])
    column = np.repeat(c.window - 1 - offset, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    flat = np.frombuffer(b"".join(data), dtype=np.uint8)
    owner = np.repeat(np.arange(m), sizes)
    marked = np.zeros((m, c.window), dtype=bool)
    big = np.int64(1) << np.int64(62)
    with tempfile.TemporaryFile() as file:
        step = 64
        for first in range(0, width, step):  # the file holds the columns one after the other; 0xFF stands where a piece has no byte
            inside = (column >= first) & (column < first + step)
            some = np.full((min(step, width - first), m), 0xFF, dtype=np.uint8)
            some[column[inside] - first, owner[inside]] = flat[inside]
            file.write(some.tobytes())
        order = np.arange(m)
        common = np.zeros(m + 1, dtype=np.uint8)  # with the one before; counts to ``length``
        for k in range(width - 1, -1, -1):
            file.seek(k * m)
            symbols = np.frombuffer(file.read(m), dtype=np.uint8)[order]
            perm = np.argsort(symbols, kind="stable")
            symbols = symbols[perm]
            same = np.flatnonzero(symbols[1:] == symbols[:-1])
            ends = np.stack([perm[same] + 1, perm[same + 1] + 1], axis=1).ravel()
            longer = np.zeros(m + 1, dtype=np.uint8)
            if len(ends):
                longer[same + 1] = np.minimum(np.minimum.reduceat(common, ends)[::2], c.length - 1) + 1
            order, common = order[perm], longer
            behind = c.window - 1 - k
            if behind >= 0:
                has = (behind <= offset) & (behind > offset - starts)
                begins = np.flatnonzero(common[:m] < c.length)
                r = np.where(has[order], rank[order], big)
                least = np.repeat(np.minimum.reduceat(r, begins), np.diff(np.r_[begins, m]))
                marked[order, behind] = (r < big) & (r != least)
    return marked


def _meet(batches: Iterator[pa.RecordBatch], c: SuffixConfig) -> Iterator[pa.RecordBatch]:
    """Marks repeats among the pieces of each bucket; rows come sorted by (h, part).

    Returns runs of marked starts (th, a, b), and the unmarked strings of anchors that fill several buckets.
    """
    names = ["th", "a", "b", "none", "doc", "s"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]

    def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts).combine_chunks()
        q, th, none = t.column("q").to_numpy(), t.column("th").to_numpy(), t.column("none").to_numpy()
        doc = t.column("doc").fill_null(0).to_numpy()
        p, off, n = q >> 16, (q >> 8) & 255, q & 255
        rank = np.empty(len(q), dtype=np.int64)
        rank[np.lexsort((p + off, th, doc, none))] = np.arange(len(q))
        data = t.column("s").to_pylist()
        marked = mark_repeats(data, off, n, rank, c)
        edges = np.diff(np.pad(marked, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, low = np.nonzero(edges == 1)
        high = np.nonzero(edges == -1)[1] - 1  # offsets low..high: starts a - high .. a - low
        a = p[row] + off[row]
        for at in range(0, len(row), 50_000):
            s = slice(at, at + 50_000)
            size = len(row[s])
            yield pa.RecordBatch.from_arrays([pa.array(th[row[s]]), pa.array((a - high)[s]), pa.array((a - low)[s]), *[pa.nulls(size, x) for x in types[3:]]], names=names)
        common = np.flatnonzero(t.column("common").to_numpy(zero_copy_only=False))
        out = []
        for k in common:
            for i in range(n[k]):
                if not marked[k, off[k] - i]:
                    out.append((int(th[k]), int(p[k]) + i, None, bool(none[k]), int(doc[k]), data[k][i : i + c.length]))
            if len(out) >= 20_000 or (k == common[-1] and out):
                yield pa.RecordBatch.from_arrays([pa.array(x, type=y) for x, y in zip(zip(*out, strict=True), types, strict=True)], names=names)
                out = []

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        h, part = batch.column("h").to_numpy(), batch.column("part").to_numpy()
        new = np.flatnonzero((h[1:] != h[:-1]) | (part[1:] != part[:-1])) + 1
        begin = 0
        if held and (held[-1].column("h")[-1].as_py(), held[-1].column("part")[-1].as_py()) != (h[0], part[0]):
            new = np.r_[0, new]
        for at in new.tolist():
            if size + at - begin >= c.bucket:
                yield from done([*held, batch.slice(begin, at - begin)])
                held, size, begin = [], 0, at
        if begin < batch.num_rows:
            held.append(batch.slice(begin))
            size += batch.num_rows - begin
    if size:
        yield from done(held)


def _cut_out(batches: Iterator[pa.RecordBatch], c: SuffixConfig) -> Iterator[pa.RecordBatch]:
    """Spans and the bytes that are left of each document."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sizes, spans, kept = [], [], []
            for text, copy, runs in zip(part.column("text"), part.column("copy").to_pylist(), part.column("runs"), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                if copy and len(data) >= c.length:
                    mine = [(0, len(data))]
                elif runs.is_valid and len(runs):
                    a, b = (runs.values.field(x).to_numpy() for x in ("a", "b"))
                    order = np.argsort(a, kind="stable")
                    a, end = a[order], np.maximum.accumulate(b[order] + c.length)
                    first = np.flatnonzero(np.r_[True, a[1:] > end[:-1]])
                    mine = list(zip(a[first].tolist(), end[np.r_[first[1:], len(a)] - 1].tolist(), strict=True))
                else:
                    mine = []
                edges = [0, *[x for s in mine for x in s], len(data)]
                sizes.append(len(data))
                spans.append([{"start": x, "end": y} for x, y in mine])
                kept.append(b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, type=pa.int64()), pa.array(spans, type=span), pa.array(kept, type=pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


def _text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def _identified(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, th, text): th tells texts apart by 128 bits, though it has 64: of texts that share a first hash, all but one take a hash of both their hashes."""
    rows = docs.select("doc_id", F.col("doc_id").cast("long").alias("doc"), _text_hash(F.col("text")).alias("_one"), F.xxhash64(F.lit(1), "text").alias("_two"), "text")
    shared = rows.groupBy("_one").agg(F.min("_two").alias("_least"), F.max("_two").alias("_most")).where("_least != _most").select("_one", "_least")
    both = rows.join(cut(shared, "shared-hashes"), "_one", "left")
    th = F.when(F.col("_two") != F.col("_least"), F.xxhash64("_one", "_two")).otherwise(F.col("_one"))
    return both.select("doc_id", "doc", th.alias("th"), "text")


def remove_repeats(docs: DataFrame, config: SuffixConfig = SuffixConfig()) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): each document's bytes without those covered by a string that starts earlier.

    A string is any ``length`` bytes of a text's UTF-8; earlier is a smaller doc_id, or the same document and an earlier start. Overlaps count,
    and all is judged on the input. spans are the maximal removed runs [start, end). Null texts are empty; texts shorter than a string stay. Null ids
    come last. Rows with equal doc_id and text are one document in several rows and are treated alike; rows with one doc_id
    and different texts are ordered by a hash of the text. Other columns are ignored. An empty table gives an empty result.
    """
    spark, c = docs.sparkSession, config
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _identified(docs)
    texts = rows.select("doc", "th", "text")
    long = texts.where(F.octet_length("text") >= c.length)
    places = long.select("th", "text").mapInArrow(lambda b: _locate(b, c), "h long, th long, q long")
    dealt = places.repartition(parts, "h").sortWithinPartitions("h", "th", "q")
    repeated = cut(dealt.mapInArrow(lambda b: _repeated(b, c), "h long, part long, th long, q long"), "places")

    first = F.struct(F.col("doc").isNull().alias("none"), "doc")
    of_text = repeated.groupBy("th").agg(F.collect_list(F.struct("h", "part", "q")).alias("places"))
    once = long.groupBy("th").agg(F.min(first).alias("at"), F.any_value("text").alias("text"))
    found = once.join(of_text, "th").select("th", "at.none", "at.doc", "text", "places")
    pieces = found.mapInArrow(lambda b: _pieces(b, c), "h long, part long, none boolean, doc long, th long, q long, s binary")
    common = repeated.where(F.col("part") > 0).select("h", F.lit(True).alias("common")).distinct()
    pieces = pieces.join(common, "h", "left").withColumn("common", F.coalesce("common", F.lit(False)))
    met = pieces.repartition(parts, "h", "part").sortWithinPartitions("h", "part")
    met = cut(met.mapInArrow(lambda b: _meet(b, c), "th long, a long, b long, none boolean, doc long, s binary"), "marks")

    left = met.where(F.col("s").isNotNull()).select("s", F.struct("none", "doc", "th", "a").alias("at"))
    earliest = left.groupBy("s").agg(F.min("at").alias("first"))
    again = left.join(earliest, "s").where(F.col("at") != F.col("first")).select("at.th", F.col("at.a").alias("a"), F.col("at.a").alias("b"))
    runs = met.where(F.col("s").isNull()).select("th", "a", "b").union(again)
    runs = runs.groupBy("th").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    firsts = texts.groupBy("th").agg(F.min(first).alias("first"))
    rows = rows.select("doc_id", "th", "text", first.alias("at"))
    judged = rows.join(firsts.join(runs, "th", "left"), "th").select("doc_id", "text", (F.col("at") != F.col("first")).alias("copy"), "runs")
    schema = docs.select("doc_id").schema.add("n_bytes", "long").add("spans", ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))).add("kept", "binary")
    return judged.mapInArrow(lambda b: _cut_out(b, c), schema)

