"""Join of documents on the Jaccard similarity of their word n-grams, by a MinHash LSH forest.

Documents with the same set of n-grams are one node. A node's signature is cut into the labels of
``trees`` prefix tries. In the sorted order of a trie, nodes that share a long prefix stand together; prefixes
are shortened step by step to the depth at which a pair at the threshold is met with the target recall. On the
way, a node that is close to the first of its run joins it and isn't compared further in this trie; the
radius of what a leader stands for widens the distance at which others are linked to it, so
the triangle inequality of the Jaccard distance keeps every pair. Each task does this for its own rows first, and
only its leaders are dealt out by prefix. Linked nodes form clusters, and within clusters all pairs are
verified on the n-grams themselves, block by block.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, row
from .components import components

_WORD = re.compile(r"\w+")
ROWS = 256


@dataclass(frozen=True)
class JoinConfig:
    ngram: int = 5
    similarity: float = 0.8
    trees: int = 12
    deepest: int = 5
    recall: float = 0.999
    #: Greatest estimated distance of what a leader stands for.
    radius: float = 0.25
    #: Three standard errors of the estimated distance.
    noise: float = 0.16
    #: Nodes that a task compares before its leaders are dealt out, and nodes in a block of the verification.
    batch: int = 20_000
    block: int = 256

    @property
    def width(self) -> int:
        return self.trees * self.deepest

    @property
    def depth(self) -> int:
        """The longest prefix that meets a pair at the threshold with the target recall."""
        for d in range(self.deepest, 0, -1):
            if 1 - (1 - self.similarity**d) ** self.trees >= self.recall:
                return d
        raise ValueError("no prefix reaches the recall: more trees are needed")


_ODD = np.random.default_rng(11).integers(0, 1 << 63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(12).integers(0, 1 << 63, 512, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def ngram_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's n-grams of lower-case words; of fewer words, all of them as one."""
    words = [_WORD.findall(t.lower()) if t else [] for t in texts]
    sizes = np.array([len(w) for w in words])
    flat = pa.array([x for w in words for x in w], type=pa.string()).dictionary_encode()
    hashes = np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in flat.dictionary.to_pylist()], dtype=np.uint64)
    h = hashes[flat.indices.to_numpy()] if len(flat) else np.zeros(0, dtype=np.uint64)
    m = max(0, len(h) - n + 1)
    grams = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        grams = _mixed(grams + h[k : k + m])
    out, at = [], 0
    for size in sizes:
        if size >= n:
            out.append(np.unique(grams[at : at + size - n + 1]))
        elif size:
            whole = np.uint64(size)
            for x in h[at : at + size]:
                whole = _mixed(np.array([whole]) + x)[0]
            out.append(np.array([whole], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += size
    return out


def signatures(sets: list[np.ndarray], width: int) -> np.ndarray:
    """For each non-empty set, 16 bits of the minimum of each hash function."""
    flat = np.concatenate(sets)
    begins = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    out = np.zeros((len(sets), width), dtype=np.uint16)
    for k in range(width):
        # the odd multiplier permutes; folding spreads its high bits before the minimum
        v = flat * _ODD[k] + _ADD[k]
        v ^= v >> np.uint64(32)
        out[:, k] = (_mixed(np.minimum.reduceat(v, begins)) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def _signed(batches: Iterator[pa.RecordBatch], config: JoinConfig) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            sets = ngram_sets(part.column("text").to_pylist(), config.ngram)
            full = [s for s in sets if len(s)]
            sig = iter(signatures(full, config.width)) if full else iter(())
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array(keys, type=pa.binary()), pa.array([next(sig).tobytes() if len(s) else None for s in sets], type=pa.binary())], names=["doc_id", "th", "k", "sig"])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, width)


class _Forest:
    """Climbs the tries over some nodes; collects the links that connect them."""

    def __init__(self, sig: np.ndarray, config: JoinConfig):
        self.sig, self.config = sig, config
        self.parent = list(range(len(sig)))
        self.links: list[tuple[int, int]] = []

    def _root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def _link(self, a: int, b: int) -> None:
        ra, rb = self._root(a), self._root(b)
        if ra != rb:
            self.parent[max(ra, rb)] = min(ra, rb)
            self.links.append((a, b))

    def _meet(self, run: np.ndarray, radius: np.ndarray, alone: np.ndarray) -> None:
        c = self.config
        while len(run) > 1:
            head, rest = run[0], run[1:]
            apart = 1 - (self.sig[rest] == self.sig[head]).mean(axis=1)
            joins = apart + radius[rest] <= c.radius
            if joins.any():  # what joins leaves the run with this step, so the radius that the others are held against has it
                radius[head] = max(radius[head], (apart + radius[rest])[joins].max())
                alone[rest[joins]] = False
            near = joins | (apart <= radius[head] + radius[rest] + (1 - c.similarity) + c.noise)
            for x in rest[near]:
                self._link(int(head), int(x))
            run = rest[~joins]

    def climb(self, label: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Shortens prefixes of one trie's labels from the deepest; the mask of leaders that are left. Widens ``radius``."""
        alone = np.ones(len(label), dtype=bool)
        order = np.lexsort(label.T[::-1])
        for d in range(self.config.deepest, self.config.depth - 1, -1):
            order = order[alone[order]]
            same = (label[order[1:], :d] == label[order[:-1], :d]).all(axis=1)
            if same.any():
                edges = np.flatnonzero(np.diff(np.r_[False, same, False].astype(np.int8)))
                for a, b in zip(edges[::2], edges[1::2], strict=True):
                    self._meet(order[a : b + 1], radius, alone)
        return alone


_OUT = "tree int, prefix long, k binary, sig binary, radius double, other binary"
_NAMES = ["tree", "prefix", "k", "sig", "radius", "other"]


def _rows(tree, prefix, k, sig, radius, other) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.float64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip((tree, prefix, k, sig, radius, other), types, strict=True)], names=_NAMES)


def _link_rows(links: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    none = [None] * len(links)
    return _rows(none, none, [a for a, _ in links], none, none, [b for _, b in links])


def _combine(batches: Iterator[pa.RecordBatch], config: JoinConfig) -> Iterator[pa.RecordBatch]:
    """Links between the nodes of a task, and for each trie its leaders."""

    def flush(keys: list[bytes], sig: np.ndarray) -> Iterator[pa.RecordBatch]:
        forest = _Forest(sig, config)
        raw = [s.tobytes() for s in sig]
        for t in range(config.trees):
            label = sig[:, t * config.deepest : (t + 1) * config.deepest]
            radius = np.zeros(len(sig))
            at = np.flatnonzero(forest.climb(label, radius))
            prefix = np.zeros(len(at), dtype=np.int64)
            for d in range(config.depth):
                prefix = (prefix << 16) | label[at, d].astype(np.int64) if d < 3 else (prefix * 1_000_003) ^ label[at, d].astype(np.int64)
            for a in range(0, len(at), 4096):
                i = at[a : a + 4096]
                yield _rows(np.full(len(i), t), prefix[a : a + 4096], [keys[x] for x in i], [raw[x] for x in i], radius[i], [None] * len(i))
        if forest.links:
            yield _link_rows([(keys[a], keys[b]) for a, b in forest.links])

    keys, sigs = [], []
    for batch in batches:
        for at in range(0, batch.num_rows, config.batch):
            part = batch.slice(at, config.batch)
            keys += part.column("k").to_pylist()
            sigs.append(_matrix(part.column("sig"), config.width))
            if len(keys) >= config.batch:
                yield from flush(keys, np.concatenate(sigs))
                keys, sigs = [], []
    if keys:
        yield from flush(keys, np.concatenate(sigs))


def _meet_leaders(batches: Iterator[pa.RecordBatch], config: JoinConfig) -> Iterator[pa.RecordBatch]:
    """Links between leaders; the rows come sorted by (tree, prefix)."""

    def runs() -> Iterator[pa.Table]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, prefix = (batch.column(c).to_numpy() for c in ("tree", "prefix"))
            starts = np.flatnonzero((tree[1:] != tree[:-1]) | (prefix[1:] != prefix[:-1])) + 1
            if rest and (rest[-1].column("tree")[-1].as_py(), rest[-1].column("prefix")[-1].as_py()) != (tree[0], prefix[0]):
                yield rest
                rest = []
            bounds = [0, *starts.tolist(), batch.num_rows]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b < batch.num_rows and not rest and b - a == 1:
                    continue
                rest.append(batch.slice(a, b - a))
                if b < batch.num_rows:
                    yield rest
                    rest = []
        if rest:
            yield rest

    for run in runs():
        t = pa.Table.from_batches(run)
        if t.num_rows < 2:
            continue
        sig = _matrix(t.column("sig"), config.width)
        tree = t.column("tree")[0].as_py()
        forest = _Forest(sig, config)
        forest.climb(sig[:, tree * config.deepest : (tree + 1) * config.deepest], t.column("radius").to_numpy().copy())
        if forest.links:
            keys = t.column("k").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([keys[a] for a, _ in forest.links], type=pa.binary()), pa.array([keys[b] for _, b in forest.links], type=pa.binary())], names=["u", "v"])


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The number of common hashes of each pair of sets."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.r_[True, flat[1:] != flat[:-1]]
    group = np.cumsum(first) - 1
    shared = np.bincount(group)[group] > 1
    group, owner = group[shared], owner[shared]
    _, group = np.unique(group, return_inverse=True)
    out = np.zeros((len(sets), len(sets)), dtype=np.int64)
    step = 4096
    for at in range(0, int(group[-1]) + 1 if len(group) else 0, step):
        a, b = np.searchsorted(group, [at, at + step])
        x = np.zeros((len(sets), step), dtype=np.float32)
        x[owner[a:b], group[a:b] - at] = 1
        out += np.rint(x @ x.T).astype(np.int64)
    return out


def _verify(batches: Iterator[pa.RecordBatch], config: JoinConfig) -> Iterator[pa.RecordBatch]:
    """Of each pair of blocks: the links of each node, and links that connect what is linked. Rows come sorted by (cluster, i, j)."""
    t = round(config.similarity * 1000)

    def done(i: int, j: int, rows: list[tuple]) -> pa.RecordBatch | None:
        keys, weights, blocks = [r[0] for r in rows], np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        sets = [np.frombuffer(r[3], dtype=np.uint64) for r in rows]
        sizes = np.array([len(s) for s in sets])
        both = _overlaps(sets)
        linked = 1000 * both >= t * (sizes[:, None] + sizes[None, :] - both)
        np.fill_diagonal(linked, False)
        if i != j:
            linked &= blocks[:, None] != blocks[None, :]
        links = linked @ weights
        at = np.flatnonzero(links)
        if not len(at):
            return None
        forest = _Forest(np.zeros((len(rows), 1), dtype=np.uint16), config)
        for a, b in zip(*np.nonzero(np.triu(linked)), strict=True):
            forest._link(int(a), int(b))
        k = [*[keys[x] for x in at], *[keys[a] for a, _ in forest.links]]
        other = [*[None] * len(at), *[keys[b] for _, b in forest.links]]
        return pa.RecordBatch.from_arrays([pa.array(k, type=pa.binary()), pa.array([*links[at].tolist(), *[None] * len(forest.links)], type=pa.int64()), pa.array(other, type=pa.binary())], names=["k", "links", "other"])

    group, rows = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("cluster", "i", "j", "k", "weight", "block", "set")]
        for cluster, i, j, k, weight, block, s in zip(*columns, strict=True):
            if group != (cluster, i, j):
                if len(rows) > 1 and (out := done(group[1], group[2], rows)):
                    yield out
                group, rows = (cluster, i, j), []
            rows.append((k, weight, block, s))
    if len(rows) > 1 and (out := done(group[1], group[2], rows)):
        yield out


def similar_classes(docs: DataFrame, config: JoinConfig = JoinConfig()) -> DataFrame:
    """(doc_id, th, class_id, n_links) of each row of ``docs``; th is the hash of its text.

    A link is a Jaccard similarity of at least ``similarity`` between the sets of n-grams of two rows. n_links counts a row's links to other rows,
    copies included. A class is what links connect; class_id is its least doc_id that isn't null. Texts of fewer than ``ngram``
    words are one n-gram of all their words. Texts without a word, empty and null ones are linked to nothing: their class_id is their
    doc_id. Repeated rows are copies of each other. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    parts = lambda: int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    signed = cut(texts.mapInArrow(lambda b: _signed(b, config), texts.select("doc_id", "th").schema.add("k", "binary").add("sig", "binary")), "signatures")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    nodes = cut(signed.where(F.col("k").isNotNull()).groupBy("k").agg(F.min(first).alias("at"), F.count(F.lit(1)).alias("weight"), F.first("sig").alias("sig")), "nodes")

    climbed = cut(nodes.select("k", "sig").mapInArrow(lambda b: _combine(b, config), _OUT), "leaders")
    met = climbed.where(F.col("other").isNull()).repartition(parts(), "tree", "prefix").sortWithinPartitions("tree", "prefix").select("tree", "prefix", "k", "sig", "radius")
    links = met.mapInArrow(lambda b: _meet_leaders(b, config), "u binary, v binary").union(climbed.where(F.col("other").isNotNull()).select("k", "other"))
    clusters = cut(components(links, "candidate-links"), "clusters").withColumnRenamed("node", "k").withColumnRenamed("root", "cluster")

    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / config.block).cast("int").alias("blocks"))
    members = cut(clusters.join(sizes, "cluster").join(nodes.select("k", "at", "weight"), "k"), "cluster-members")
    wanted = members.select("k", "cluster", "blocks", "weight", F.col("at.doc_id").alias("_d"), F.col("at.th").alias("_th"))
    # merged at every size, so the need for disk grows in proportion
    found = texts.join(wanted.hint("merge"), texts.doc_id.eqNullSafe(F.col("_d")) & (texts.th == F.col("_th"))).select("k", "cluster", "blocks", "weight", "text")
    schema = found.drop("text").schema.add("set", "binary")

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                sets = ngram_sets(part.column("text").to_pylist(), config.ngram)
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array([s.tobytes() for s in sets], type=pa.binary())], names=["k", "cluster", "blocks", "weight", "set"])

    sets = cut(found.mapInArrow(as_sets, schema).dropDuplicates(["k"]), "cluster-sets").withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    pairs = sets.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cluster", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "k", "weight", "block", "set")
    dealt = pairs.repartition(parts(), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    verified = cut(dealt.mapInArrow(lambda b: _verify(b, config), "k binary, links long, other binary"), "verified")
    classes = components(verified.where(F.col("other").isNotNull()).select(F.col("k").alias("u"), F.col("other").alias("v")), "links").withColumnRenamed("node", "k")
    counted = verified.where(F.col("other").isNull()).groupBy("k").agg(F.sum("links").alias("links"))

    full = nodes.select("k", "at", "weight").join(classes, "k", "left").join(counted, "k", "left").withColumn("root", F.coalesce("root", "k"))
    least = full.groupBy("root").agg(F.min("at").alias("least"))
    info = cut(full.join(least, "root").select("k", F.col("least.doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "classes")
    named = signed.select("doc_id", "th", "k").join(info, "k", "left")
    return named.select("doc_id", "th", F.when(F.col("k").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one_of_each(docs: DataFrame, config: JoinConfig = JoinConfig()) -> DataFrame:
    """The rows of ``docs``, of each class only the one of least doc_id (then least hash of its text; null ids last).

    Rows without a word stay. Of repeated rows one stays. All columns pass through, whatever their names.
    """
    linked = cut(similar_classes(docs, config).where(F.col("n_links") > 0), "linked")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    first = linked.groupBy("class_id").agg(F.min(place).alias("at"))
    first = first.select(F.col("at.doc_id").alias("_d"), F.col("at.th").alias("_th"), F.lit(True).alias("_stays"))
    rows = linked.select(F.col("doc_id").alias("_d"), F.col("th").alias("_th")).distinct()
    fate = cut(rows.alias("r").join(first.alias("f"), F.col("r._d").eqNullSafe(F.col("f._d")) & (F.col("r._th") == F.col("f._th")), "left").select("r._d", "r._th", F.coalesce("_stays", F.lit(False)).alias("_stays")), "fates")
    mine = docs.select(row(docs), F.col("doc_id").alias("_own"), F.xxhash64("text").alias("_own_th"))
    judged = mine.join(fate, F.col("_own").eqNullSafe(F.col("_d")) & (F.col("_own_th") == F.col("_th")), "left")
    clean = judged.where(F.col("_stays").isNull()).select("_row")
    kept = judged.where(F.col("_stays")).dropDuplicates(["_own", "_own_th"]).select("_row")
    return clean.union(kept).select("_row.*")
