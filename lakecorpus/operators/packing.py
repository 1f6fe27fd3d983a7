"""Next-fit packing of a whole table in one order, without a task that sees all of it.

Rows are sorted by position and cut into blocks. What comes into a block is only how full the pack is that is open there; so a block is a function from that
to how full the pack is that it leaves open, and how many it closes. The function depends on the first row that doesn't fit any more, and few rows come in question: as many as fit one pack. Within a
block the pack that starts at a row ends where running sums say, and pointer doubling over those ends gives the last pack of each start. The functions of the blocks, a row each, are
applied one after the other; then every block knows what comes into it and numbers its packs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lakecorpus.functions.batches import parts

from .dedup import checkpointed
from .training_rows import IGNORE


@dataclass(frozen=True)
class PackConfig:
    limit: int
    #: What a row costs besides its size where it isn't the first of its pack.
    joint: int = 0
    #: Most rows of a pack; None for any number.
    most_rows: int | None = None
    #: Rows of a block at most.
    block: int = 1 << 20


_NOTHING_FITS = 1 << 62


class Block:
    """Ends of packs in a run of rows (sizes, and which rows stand alone)."""

    def __init__(self, size: np.ndarray, alone: np.ndarray, config: PackConfig):
        self.config, self.n = config, len(size)
        rows = np.arange(self.n)
        self.alone = alone
        self.sums = np.r_[0, np.cumsum(size + config.joint)]  # of the rows before
        single = np.flatnonzero(alone)
        next_single = np.r_[single, self.n][np.searchsorted(single, rows, side="right")]
        ends = np.searchsorted(self.sums[1:], self.sums[:-1] + config.joint + config.limit, side="right")
        ends = np.minimum(ends, next_single)
        if config.most_rows:
            ends = np.minimum(ends, rows + config.most_rows)
        self.ends = np.where(alone, rows + 1, np.maximum(ends, rows + 1))

    def first_new(self, used: int, count: int) -> int:
        """The first row that begins a pack if one of ``count`` rows is open, ``used`` full (without rows there is none)."""
        if not count or not self.n:
            return 0
        at = int(np.searchsorted(self.sums[1:], self.config.limit - used, side="right"))
        if self.config.most_rows:
            at = min(at, max(self.config.most_rows - count, 0))
        alone = np.flatnonzero(self.alone[: at + 1])
        return min(at, int(alone[0]) if len(alone) else at)

    def summary(self) -> dict:
        """The function of the block: for each row that can begin the first new pack, what the block leaves open and how many packs begin in it."""
        few = min(self.n, int(np.searchsorted(self.sums[1:], self.config.limit, side="right")) + 1)
        rows = np.arange(self.n)
        inside = self.ends < self.n
        last, hops = np.where(inside, self.ends, rows), inside.astype(np.int64)
        while True:  # pointer doubling
            further = last[last]
            if (further == last).all():
                break
            hops, last = hops + hops[last], further
        last, hops = last[:few], hops[:few]
        used = np.where(self.alone[last], _NOTHING_FITS, self.sums[-1] - self.sums[last] - self.config.joint)
        single = np.flatnonzero(self.alone)
        return {"sums": self.sums[1 : few + 1].tolist(), "used": used.tolist(), "count": (self.n - last).tolist(), "begun": (hops + 1).tolist(), "n": self.n, "total": int(self.sums[-1]), "single": int(single[0]) if len(single) else self.n}

    def starts(self, first: int) -> np.ndarray:
        """Marks the rows that begin packs, from the first on."""
        mark = np.zeros(self.n, dtype=bool)
        at = first
        while at < self.n:
            mark[at] = True
            at = int(self.ends[at])
        return mark


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, pa.Table]]:
    """Tables of up to ``most`` rows of one part of the sort, each with its number."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> Iterator[tuple[int, pa.Table]]:
        at = table.column("_at").to_numpy()
        # a part's rows are numbered from a multiple of 2^33 on, without gaps
        blocks = (at >> 33 << 33) + (at & ((1 << 33) - 1)) // most
        edges = np.r_[0, np.flatnonzero(np.diff(blocks)) + 1, len(blocks)]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b > a:
                yield int(blocks[a]), table.slice(a, b - a)

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) > 2 * most:
            *whole, (_, rest) = cut(pa.Table.from_batches(held))
            yield from whole
            held = rest.to_batches()
    if held:
        yield from cut(pa.Table.from_batches(held))


def _block_of(table: pa.Table, config: PackConfig) -> Block:
    return Block(table.column("size").to_numpy(), table.column("alone").to_numpy(), config)


_SUMMARY = "block long, sums array<long>, used array<long>, count array<long>, begun array<long>, n long, total long, single long"
_ENTRY = "block long, used long, count long, pack long"


def _enter(batches: Iterator[pa.RecordBatch], config: PackConfig) -> Iterator[pa.RecordBatch]:
    """What comes into each block, from the summaries of all blocks in order: a row each."""
    used, count, pack = 0, 0, -1  # of the pack that is open, and its number
    for batch in batches:
        rows = []
        for s in batch.to_pylist():
            rows.append({"block": s["block"], "used": used, "count": count, "pack": pack})
            fits = int(np.searchsorted(s["sums"], config.limit - used, side="right")) if count else 0
            if count:
                fits = min(fits, s["single"], max(config.most_rows - count, 0) if config.most_rows else fits)
            if count and fits >= s["n"]:
                used, count = used + s["total"], count + s["n"]
            else:
                used, count, pack = s["used"][fits], s["count"][fits], pack + s["begun"][fits]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c, pa.int64()) for c in ("block", "used", "count", "pack")]))


def next_fit(rows: DataFrame, config: PackConfig, position: str = "position") -> DataFrame:
    """(position, pack, place): the pack of each row (position, size, alone), from 0, in the order of position, and its place in it, from 0.

    A pack ends before a row that would overfill it; a row over the limit has a pack of its own, and so has one that is ``alone`` (null: not). Without that column none is. Positions are unique.
    An empty table gives an empty result.
    """
    if config.limit <= 0:
        raise ValueError("the limit must be positive")
    alone = F.coalesce(F.col("alone"), F.lit(False)) if "alone" in rows.columns else F.lit(False)
    # sizes may be dear to tell; a range sort would ask for them twice
    sizes = checkpointed(rows.select(F.col(position), F.col("size").cast("long").alias("size"), alone.alias("alone")))
    placed = checkpointed(sizes.orderBy(position).withColumn("_at", F.monotonically_increasing_id()))

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in _blocks(batches, config.block):
            s = {"block": block, **_block_of(table, config).summary()}
            lists = {"sums", "used", "count", "begun"}
            yield pa.RecordBatch.from_pylist([s], schema=pa.schema([(k, pa.list_(pa.int64()) if k in lists else pa.int64()) for k in s]))

    # a row for each block
    found = placed.select("_at", "size", "alone").mapInArrow(summaries, _SUMMARY)
    entries = checkpointed(found.repartition(1).sortWithinPartitions("block").mapInArrow(lambda b: _enter(b, config), _ENTRY))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in _blocks(batches, config.block):
            block = _block_of(table, config)
            used, count, pack = (table.column(c)[0].as_py() for c in ("used", "count", "pack"))
            starts = block.starts(block.first_new(used, count))
            packs = pack + np.cumsum(starts)
            begin = np.maximum.accumulate(np.where(starts, np.arange(block.n), -count))
            out = [table.column(position).combine_chunks(), pa.array(packs), pa.array(np.arange(block.n) - begin)]
            yield from pa.Table.from_arrays(out, names=[position, "pack", "place"]).to_batches()

    part, most = F.shiftright("_at", 33), config.block
    block = F.shiftleft(part, 33) + F.floor(F.col("_at").bitwiseAND((1 << 33) - 1) / most)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = placed.withColumn("block", block).join(entries, "block").repartition(n, "block").sortWithinPartitions("_at")
    schema = placed.select(position).schema.add("pack", "long").add("place", "long")
    return joined.select(position, "_at", "size", "alone", "used", "count", "pack").mapInArrow(numbered, schema)


#: Columns of a row besides ids and labels, with what stands for them at an end token and in padding (None: not one for each token).
_OF_TOKENS = ("attention_mask", "word_pos", "morph_depth", "offsets")
_OF_MEDIA = {"image_spans": ("images", "image_sizes", "ocr_labels", "reading_order"), "video_spans": ("videos", "video_sizes")}


def trim(rows: DataFrame, limit: int) -> DataFrame:
    """Rows cut to the limit, in front of a span of an image or video that it would cut in two; what belongs to spans that are lost goes as well.

    Needs ids and labels; word_pos, morph_depth, offsets (start, end), image_spans and video_spans (start, end), and the lists images, image_sizes, ocr_labels, reading_order, videos and video_sizes are cut if they are there.
    Adds ``alone``: true for a row with a span before it is cut.
    """
    spans = [c for c in _OF_MEDIA if c in rows.columns]
    every = F.concat(*[F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType)) for c in spans]) if spans else None
    cut_in_two = F.array_min(F.transform(F.filter(every, lambda s: (s["start"] < limit) & (s["end"] > limit)), lambda s: s["start"])) if spans else F.lit(None).cast("int")
    d = rows.withColumn("_over", F.size("ids") > limit)
    over = F.col("_over")
    d = d.withColumn("_cut", F.when(over, F.coalesce(cut_in_two, F.lit(limit))).otherwise(F.size("ids")).cast("int"))
    d = d.withColumn("alone", F.coalesce(F.size(every) > 0, F.lit(False)) if spans else F.lit(False))
    for c in ("ids", "labels", *[c for c in _OF_TOKENS if c in rows.columns]):
        d = d.withColumn(c, F.when(over, F.slice(F.col(c), F.lit(1), F.col("_cut"))).otherwise(F.col(c)))
    for c in spans:
        d = d.withColumn(c, F.filter(F.col(c), lambda s: s["end"] <= F.col("_cut")))
        for m in _OF_MEDIA[c]:
            if m in rows.columns:
                d = d.withColumn(m, F.when(over, F.slice(F.col(m), F.lit(1), F.size(c))).otherwise(F.col(m)))
    return d.drop("_cut", "_over")


def pad(rows: DataFrame, limit: int, pad_id: int) -> DataFrame:
    """Rows filled up to the limit with ids that nothing is learned from."""
    n = F.greatest(F.lit(limit) - F.size("ids"), F.lit(0))
    with_ = {"ids": F.lit(pad_id), "labels": F.lit(IGNORE), "attention_mask": F.lit(0), "word_pos": F.lit(0), "morph_depth": F.lit(0)}
    out = rows.withColumn("_n", n)
    for c, x in with_.items():
        if c in rows.columns:
            out = out.withColumn(c, F.concat(c, F.array_repeat(x.cast(rows.schema[c].dataType.elementType), F.col("_n"))))
    if "offsets" in rows.columns:
        out = out.withColumn("offsets", F.concat("offsets", F.array_repeat(F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end")).cast(rows.schema["offsets"].dataType.elementType), F.col("_n"))))
    return out.drop("_n")


class _Lists:
    """A list column as values and offsets; values of structs are a list of arrays."""

    def __init__(self, column: pa.Array):
        self.type = column.type
        at = column.offsets.to_numpy()
        self.offsets = (at - at[0]).astype(np.int64)
        values = column.values.slice(int(at[0]), int(at[-1] - at[0]))
        self.struct = pa.types.is_struct(values.type)
        self.values = [f.to_numpy(zero_copy_only=False) for f in values.flatten()] if self.struct else [values.to_numpy(zero_copy_only=False)]

    def joined(self, later: np.ndarray, ends: np.ndarray, firsts: np.ndarray) -> pa.Array:
        """Lists of packs: rows one behind the other, with one value of ``ends`` in front of each that isn't the first (``later``). ``firsts``: the first row of each pack."""
        sizes = np.diff(self.offsets)
        begin = np.r_[0, np.cumsum(sizes + later)]
        at = np.repeat(begin[:-1] + later - self.offsets[:-1], sizes) + np.arange(self.offsets[-1])
        out = []
        for v in self.values:
            new = np.empty(begin[-1], dtype=v.dtype)
            new[at] = v
            new[begin[:-1][later.astype(bool)]] = ends[later.astype(bool)]
            out.append(pa.array(new))
        made = pa.StructArray.from_arrays(out, fields=list(self.type.value_type)) if self.struct else out[0].cast(self.type.value_type)
        return pa.ListArray.from_arrays(pa.array(begin[np.r_[firsts, len(sizes)]].astype(np.int32)), made)


def _assemble(batches: Iterator[pa.RecordBatch], eos: int, tokens: list[str], media: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Packs from rows sorted by pack and place; a pack that goes on in the next batch waits for it."""

    def packs(rows: pa.RecordBatch) -> pa.RecordBatch:
        place = rows.column("place").to_numpy()
        firsts = np.flatnonzero(place == 0)
        later = (place > 0).astype(np.int64)
        lists = {c: _Lists(rows.column(c)) for c in tokens}
        ends = {"ids": np.full(len(place), eos), "labels": np.full(len(place), eos), "morph_depth": np.zeros(len(place), dtype=np.int64), "offsets": np.full(len(place), -1)}
        if "word_pos" in lists:
            w = lists["word_pos"]
            sizes = np.diff(w.offsets)
            most = np.full(len(sizes), -1)
            some = np.flatnonzero(sizes)
            if len(some):
                most[some] = np.maximum.reduceat(w.values[0], w.offsets[some])
            own = most + 2  # the words of a text and an end token
            before = np.cumsum(own) - own
            before -= np.repeat(before[firsts], np.diff(np.r_[firsts, len(place)]))
            w.values = [w.values[0] + np.repeat(before, sizes)]
            ends["word_pos"] = before - 1
        columns = {"pack": rows.column("pack").take(pa.array(firsts)), "num_samples": pa.array(np.diff(np.r_[firsts, len(place)])), "alone": rows.column("alone").take(pa.array(firsts))}
        columns |= {c: lists[c].joined(later, ends[c], firsts) for c in tokens} | {c: rows.column(c).take(pa.array(firsts)) for c in media}
        return pa.RecordBatch.from_arrays([columns[n].cast(schema.field(n).type) for n in schema.names], schema=schema)

    held: list[pa.RecordBatch] = []
    # what numpy makes of a batch is several times as large, so only a part of it is taken at once
    for batch in (x.slice(a, b - a) for x in batches for a, b in parts(x.column("ids"))):
        place = batch.column("place").to_numpy()
        at = np.flatnonzero(place == 0)
        if len(at):
            held.append(batch.slice(0, int(at[-1])))
            rows = pa.Table.from_batches(held).combine_chunks()
            if rows.num_rows:
                yield packs(rows.to_batches()[0])
            held = [batch.slice(int(at[-1]))]
        else:
            held.append(batch)
    if held:
        rows = pa.Table.from_batches(held).combine_chunks()
        if rows.num_rows:
            yield packs(rows.to_batches()[0])


def pack_samples(rows: DataFrame, limit: int, eos: int, pad_id: int | None = None, position: str = "doc_id", block: int = 1 << 20) -> DataFrame:
    """Packs of rows in the order of position: (pack, num_samples, alone, ids, labels, attention_mask, and what else ``trim`` names of the rows' columns).

    A text goes behind others with a supervised end token in between, whose word_pos goes on from theirs, with depth 0 and offsets of -1; the words of the next text are counted on from there. A row with
    an image or video closes the pack before it and is one of its own, with its media; packs of texts have none. Rows are cut to the limit first; those without ids
    (null, too) are left out; null lists are empty. With ``pad_id`` packs are filled up to the limit. Positions are unique.
    """
    named = [c for c in (*_OF_TOKENS, *_OF_MEDIA, *[m for ms in _OF_MEDIA.values() for m in ms]) if c in rows.columns and c != "attention_mask"]
    tokens = [c for c in ("ids", "labels", *_OF_TOKENS) if c in ("ids", "labels") or c in named]
    media = [c for c in named if c not in tokens]
    d = trim(rows.select(F.col(position).alias("_position"), "ids", "labels", *named).where(F.size("ids") > 0), limit).where(F.size("ids") > 0)
    places = next_fit(d.select("_position", F.size("ids").alias("size"), "alone"), PackConfig(limit, 1, block=block), "_position")
    empty = {c: F.array().cast(d.schema[c].dataType) for c in (*tokens, *media)}
    whole = [F.coalesce(c, empty[c]).alias(c) for c in tokens] + [F.when(F.col("alone"), F.coalesce(c, empty[c])).otherwise(empty[c]).alias(c) for c in media]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = d.join(places, "_position").select("pack", "place", "alone", *whole).repartition(n, "pack").sortWithinPartitions("pack", "place")
    out = dealt.select("pack", F.col("pack").alias("num_samples"), "alone", *tokens, *media).schema
    arrow = to_arrow_schema(out)
    made = dealt.mapInArrow(lambda b: _assemble(b, eos, tokens, media, arrow), out)
    made = made.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("ids")))
    return made if pad_id is None else pad(made, limit, pad_id)
