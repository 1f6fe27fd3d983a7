"""Training rows: labels, truncation, span masks, word positions, packing, gates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from lakecorpus.functions.batches import cut_lists, list_places, lists_from, parts, utf8_bytes

IGNORE = -100
#: Tokens that are never supervised (fixed values).
IGNORED_TOKENS = (
    "<pad>", "<unk>", "<bos>", "<img>", "<image>", "<image_start>", "<image_patch>", "<image_end>", "<video>", "<video_start>", "<video_patch>", "<video_end>",
    "<audio>", "<audio_start>", "<audio_patch>", "<audio_end>", "<bbox>", "<ocr>", "<ocr_start>", "<ocr_end>", "<doc>", "<table>", "<layout>", "◈",
)


def byte_lists(texts: pa.Array, first: int = 0) -> pa.ListArray:
    sizes, data = utf8_bytes(texts)
    return lists_from(sizes, data.astype(np.int32) + np.int32(first), texts.is_null())


def byte_ids(text: Column, first: int = 0) -> Column:
    """The byte fallback: an id for each byte of the text's UTF-8, counted from ``first``. No part of a lambda."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for a, b in parts(batch) if len(batch) else ((0, 0),):
                yield byte_lists(batch.slice(a, b - a), first)

    return run(text)


def byte_values(lists: pa.Array) -> pa.Array:
    """As ``bytes_of``."""
    at, flat = list_places(lists)
    values = flat.fill_null(-1).to_numpy(zero_copy_only=False)
    kept = (values >= 0) & (values < 256)
    ends = np.r_[0, np.cumsum(kept, dtype=np.int64)][at].astype(np.int32)
    data = pa.py_buffer(values[kept].astype(np.uint8).tobytes())
    made = pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.tobytes()), data])
    return pc.if_else(lists.is_null(), pa.scalar(None, pa.binary()), made)


def bytes_of(ids: Column) -> Column:
    """The bytes among ids as a binary value; other ids and nulls are left out. No part of a lambda."""

    @F.arrow_udf(BinaryType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for a, b in parts(batch) if len(batch) else ((0, 0),):
                yield byte_values(batch.slice(a, b - a))

    return run(ids)


def hex_pairs(marks: dict[int, str]) -> Callable[[np.ndarray], np.ndarray]:
    """A function that gives two characters for each id: bytes in hex, other ids as ``marks`` has them, nothing for those that it lacks."""
    low, high = min([0, *marks]) - 1, max([255, *marks]) + 1
    table = np.zeros(high - low + 1, dtype="S2")
    for i, mark in ({b: f"{b:02x}" for b in range(256)} | marks).items():
        table[i - low] = mark.encode("ascii")
    return lambda ids: table[np.clip(ids, low, high) - low]


def hex_text(ids: Column, marks: dict[int, str]) -> Column:
    """Ids as text by ``hex_pairs``; nulls are left out. No part of a lambda."""
    pairs_of, none = hex_pairs(marks), min([0, *marks]) - 1

    @F.arrow_udf(StringType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for a, b in parts(batch) if len(batch) else ((0, 0),):
                lists = batch.slice(a, b - a)
                at, flat = list_places(lists)
                pairs = pairs_of(flat.fill_null(none).to_numpy(zero_copy_only=False))
                kept = pairs != b""
                ends = 2 * np.r_[0, np.cumsum(kept, dtype=np.int64)][at]
                made = pa.StringArray.from_buffers(len(lists), pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(pairs[kept].tobytes()))
                yield pc.if_else(lists.is_null(), pa.scalar(None, pa.string()), made)

    return run(ids)


def byte_tokens() -> list[str]:
    return [f"<0x{b:02X}>" for b in range(256)]


def labels(ids: Column, ignored: Column) -> Column:
    """A copy of the ids with IGNORE where an id is in ``ignored``."""
    return F.transform(ids, lambda x: F.when(F.array_contains(ignored, x), F.lit(IGNORE)).otherwise(x))


def supervised(row_labels: Column) -> Column:
    return F.exists(row_labels, lambda x: x != IGNORE)


def n_supervised(labels: pa.Array) -> np.ndarray:
    """How many tokens of each row are supervised; a null row has none."""
    at, flat = list_places(labels)
    before = np.r_[0, np.cumsum(flat.fill_null(IGNORE).to_numpy(zero_copy_only=False) != IGNORE, dtype=np.int64)]
    return np.diff(before[at])


def truncation_starts(labels: pa.Array, limit: int) -> np.ndarray:
    """Where the kept part of each over-long row begins: it ends at the last supervised token, or with the row."""
    at, flat = list_places(labels)
    said = np.flatnonzero(flat.fill_null(IGNORE).to_numpy(zero_copy_only=False) != IGNORE)
    last = np.r_[-1, said][np.searchsorted(said, at[1:])]  # in front of each row's end
    sizes = np.diff(at)
    end = np.where(last >= at[:-1], last + 1 - at[:-1], sizes)
    return np.where(sizes <= limit, 0, np.maximum(end - limit, 0))


def truncation_start(row_labels: Column, limit: int) -> Column:
    """``truncation_starts`` of a column. No part of a lambda."""

    @F.arrow_udf(IntegerType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for a, b in parts(batch) if len(batch) else ((0, 0),):
                lists = batch.slice(a, b - a)
                yield pa.array(truncation_starts(lists, limit).astype(np.int32), mask=lists.is_null().to_numpy(zero_copy_only=False))

    return run(row_labels)


def truncated(ids: pa.Array, labels: pa.Array, limit: int) -> tuple[pa.ListArray, pa.ListArray]:
    """``truncate`` of rows in Arrow."""
    if limit <= 0:
        raise ValueError("the limit must be positive")
    start = truncation_starts(labels, limit)
    return cut_lists(ids, start, limit), cut_lists(labels, start, limit)


def truncate(rows: DataFrame, limit: int) -> DataFrame:
    """Cuts ids and labels to ``limit`` from the left and right so that the last supervised token stays."""
    if limit <= 0:
        raise ValueError("the limit must be positive")
    d = rows.withColumn("_s", truncation_start(F.col("labels"), limit))
    return d.withColumns({c: F.slice(c, F.col("_s") + 1, limit) for c in ("ids", "labels")}).drop("_s")


def find(row: list[int], pattern: list[int], start: int = 0) -> int:
    """Index of the first occurrence of a pattern at or after ``start``; -1 if there is none or it is empty."""
    hits = (i for i in range(start, len(row) - len(pattern) + 1) if row[i : i + len(pattern)] == pattern)
    return next(hits, -1) if pattern else -1


def span_mask(row: list[int], pairs: list[tuple[list[int], list[int]]]) -> list[int]:
    """1 outside and 0 inside each span between the markers of a pair; an open span reaches the end."""
    mask = [1] * len(row)
    for opening, closing in pairs:
        at = 0
        while (a := find(row, opening, at)) >= 0:
            b = find(row, closing, a + len(opening))
            at = b + len(closing) if b >= 0 else len(row)
            mask[a:at] = [0] * (at - a)
    return mask


def span_mask_udf(pairs: list[tuple[list[int], list[int]]]):
    @F.pandas_udf("array<int>")
    def run(rows):
        import pandas as pd

        return pd.Series([span_mask([int(x) for x in r], pairs) if r is not None else [] for r in rows])

    return run


def word_positions(tokens: DataFrame, row: str = "doc_id", position: str = "pos") -> DataFrame:
    """Adds word_pos and morph_depth to tokens (track, start, end) in order.

    A token goes on with a word if it is on the same word track as the one before and starts where that ends. Tokens of other tracks
    and those without offsets end a word and take its position. Windows over one row's tokens only.
    """
    w = Window.partitionBy(row).orderBy(position)
    word = F.col("track").isin("mn", "general") & (F.col("start") >= 0) & (F.col("end") >= 0)
    d = tokens.withColumn("_word", word)
    before = F.struct(F.lag("_word").over(w).alias("w"), F.lag("track").over(w).alias("t"), F.lag("end").over(w).alias("e"))
    d = d.withColumn("_b", before)
    goes_on = F.col("_word") & F.coalesce(F.col("_b.w") & (F.col("_b.t") == F.col("track")) & (F.col("_b.e") == F.col("start")), F.lit(False))
    d = d.withColumn("_new", F.when(F.col("_word") & ~goes_on, 1).otherwise(0))
    d = d.withColumn("_n", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.max(F.when(F.col("_new") == 1, F.col(position))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    depth = F.when(F.col("_word"), F.col(position) - first).otherwise(0)
    return d.withColumn("word_pos", F.greatest(F.col("_n") - 1, F.lit(0)).cast("int")).withColumn("morph_depth", depth.cast("int")).drop("_word", "_b", "_new", "_n")


def word_tracks(at: np.ndarray, track: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``word_positions`` of tokens in order, of which rows begin at ``at[:-1]``: word_pos and morph_depth within the rows. Tracks are numbers, those that aren't word tracks are negative."""
    sizes = np.diff(at)
    place = np.arange(len(track))
    word = (track >= 0) & (start >= 0) & (end >= 0)
    goes_on = np.zeros(len(track), dtype=bool)
    goes_on[1:] = word[1:] & word[:-1] & (track[1:] == track[:-1]) & (end[:-1] == start[1:])
    goes_on[at[:-1][sizes > 0]] = False
    new = word & ~goes_on
    words = np.r_[0, np.cumsum(new, dtype=np.int64)]
    count = words[1:] - np.repeat(words[at[:-1]], sizes)
    first = np.maximum.accumulate(np.where(new, place, 0)) if len(place) else place
    return np.maximum(count - 1, 0).astype(np.int32), np.where(word, place - first, 0).astype(np.int32)


#: Tokens that are written out together, at least.
_OUT = 1 << 18
#: Tokens of a block of packs.
BLOCK = 1 << 22


def _packs(batches: Iterator[pa.RecordBatch], limit: int, eos: int) -> Iterator[pa.RecordBatch]:
    """Packs of rows sorted by group, block and position. A block begins with a pack of its own, whose number it has as ``first``."""
    schema = pa.schema([("pack_group", pa.int64()), ("pack", pa.int64()), ("ids", pa.list_(pa.int32())), ("labels", pa.list_(pa.int32())), ("num_samples", pa.int32())])
    end = np.array([eos], dtype=np.int32)
    block, pack, size, n = None, 0, 0, 0
    cells: dict[str, list[np.ndarray]] = {"ids": [], "labels": []}
    done: list[tuple[int, int, int, int, int]] = []  # group, pack, ids, labels, samples
    before = {"ids": 0, "labels": 0}

    def close() -> None:
        now = {c: sum(map(len, x)) for c, x in cells.items()}
        done.append((block[0], pack, now["ids"] - before["ids"], now["labels"] - before["labels"], n))
        before.update(now)

    def out() -> pa.RecordBatch:
        group, packs, long, labelled, samples = np.array(done, dtype=np.int64).reshape(-1, 5).T
        lists = [lists_from(k, np.concatenate([*cells[c], np.zeros(0, dtype=np.int32)])) for c, k in (("ids", long), ("labels", labelled))]
        made = pa.RecordBatch.from_arrays([pa.array(group), pa.array(packs), *lists, pa.array(samples.astype(np.int32))], schema=schema)
        done.clear()
        for c in cells:
            cells[c], before[c] = [], 0
        return made

    written = 0
    for batch in batches:
        values = {c: list_places(batch.column(c)) for c in ("ids", "labels")}
        flat = {c: v.to_numpy(zero_copy_only=False) for c, (_, v) in values.items()}
        at = {c: a.tolist() for c, (a, _) in values.items()}
        for k, key in enumerate(zip(*(batch.column(c).to_pylist() for c in ("pack_group", "first")), strict=True)):
            row = {c: flat[c][at[c][k] : min(at[c][k + 1], at[c][k] + limit)] for c in cells}
            m = len(row["ids"])
            if not m:
                continue
            if key != block or size + 1 + m > limit:
                if n:
                    close()
                    if written > _OUT:
                        yield out()
                        written = 0
                block, pack, size, n = key, pack + 1 if key == block else key[1], 0, 0
            for c in cells:
                cells[c] += [end, row[c].astype(np.int32)] if n else [row[c].astype(np.int32)]
            size += m + (n > 0)
            written += m
            n += 1
    if n:
        close()
    yield out()


def _block_starts(batches: Iterator[pa.RecordBatch], limit: int, block: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(grp, position, first) of the packs that begin blocks: the first of each group, then each that comes ``block`` tokens or more behind the last."""
    group, shard, size, since = None, 0, 0, 0
    for batch in batches:
        chosen, firsts = [], []
        for k, (g, n) in enumerate(zip(batch.column("grp").to_pylist(), batch.column("size").to_pylist(), strict=True)):
            fresh = g != group
            if fresh:
                group, shard, size, since = g, 0, 0, 0
            elif size + 1 + n > limit:
                shard, size = shard + 1, 0
                fresh = since >= block
            if fresh:
                chosen.append(k)
                firsts.append(shard)
                since = 0
            size += n + (size > 0)
            since += n
        rows = batch.take(pa.array(chosen, type=pa.int64()))
        yield pa.RecordBatch.from_arrays([rows.column("grp"), rows.column("position"), pa.array(firsts, type=pa.int64())], schema=schema)


def pack_rows(rows: DataFrame, limit: int, eos: int, groups: int = 64, position: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """Next-fit packing of rows (ids, labels) with a supervised end token between samples.

    Rows are dealt to ``groups`` by a hash of their position, and each group is packed in order; one group gives the single pass. Rows over the
    limit are cut; empty ones are left out. A group's sizes, without its tokens, pass through one task, which tells the packs that begin blocks of some ``block`` tokens; the rows are then
    dealt out and packed block by block, so a task reads blocks, however large a group is.
    """
    if limit <= 0:
        raise ValueError("the limit must be positive")
    shuffled = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = rows.withColumn("pack_group", F.pmod(F.xxhash64(position), F.lit(groups)).cast("long")).where(F.size("ids") > 0)
    sizes = d.select(F.col("pack_group").alias("grp"), F.col(position).alias("position"), F.least(F.size("ids"), F.lit(limit)).cast("long").alias("size"))
    sizes = sizes.repartition(min(groups, shuffled), "grp").sortWithinPartitions("grp", "position")
    schema = sizes.select("grp", "position").schema.add("first", "long")
    arrow = to_arrow_schema(schema)
    # a row for each ``block`` tokens, as the bounds of a range sort
    starts = sizes.mapInArrow(lambda b: _block_starts(b, limit, block, arrow), schema).collect()
    bounds = rows.sparkSession.createDataFrame(starts, schema).groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("position", "first"))).alias("_bounds"))
    n = max(1, min(max(shuffled, groups, len(starts) // 4), len(starts)))
    last = F.array_max(F.filter("_bounds", lambda x: F.struct(x["position"]) <= F.struct(F.col(position).alias("position"))))
    dealt = d.join(F.broadcast(bounds), d["pack_group"] == bounds["grp"]).withColumn("first", last["first"])
    dealt = dealt.repartition(n, "pack_group", "first").sortWithinPartitions("pack_group", "first", position).select("pack_group", "first", "ids", "labels")
    return dealt.mapInArrow(lambda b: _packs(b, limit, eos), "pack_group long, pack long, ids array<int>, labels array<int>, num_samples int")


def _next_fit(batches: Iterator[pa.RecordBatch], budget: int, joint: int) -> Iterator[pa.RecordBatch]:
    group, shard, size = None, 0, 0
    for batch in batches:
        shards = []
        for g, n in zip(batch.column("grp").to_pylist(), batch.column("size").to_pylist(), strict=True):
            if g != group:
                group, shard, size = g, 0, 0
            cost = n + (joint if size else 0)
            if size and size + cost > budget:
                shard, size, cost = shard + 1, 0, n
            size += cost
            shards.append(shard)
        yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("position"), batch.column("size"), pa.array(shards, type=pa.int64())], names=["grp", "position", "size", "shard"])


def shard_ids(sizes: DataFrame, budget: int, joint: int = 0) -> DataFrame:
    """Adds shard to rows (grp, position, size): a new one begins before a row that would overfill it, never empty.

    ``joint`` is what a row costs besides its size where it isn't the first. A task streams its groups in order.
    """
    n = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = sizes.select("grp", "position", F.col("size").cast("long").alias("size")).repartition(n, "grp").sortWithinPartitions("grp", "position")
    schema = d.select("*").schema.add("shard", "long")
    return d.mapInArrow(lambda b: _next_fit(b, budget, joint), schema)


def gate_metrics(rows: DataFrame, unk: int, max_unk: float = 0.01, min_supervised: float = 0.01) -> DataFrame:
    """One row: samples, empty rows left out, mean and longest length, deepest morph_depth (where rows have it), shares of unknown and of supervised tokens, misaligned rows, and whether the gate passes."""
    n = F.size("ids")
    depth = F.array_max("morph_depth") if "morph_depth" in rows.columns else F.lit(0)
    full = rows.withColumn("_empty", F.coalesce(n, F.lit(0)) <= 0)
    of = lambda c: F.when(~F.col("_empty"), c)
    total = lambda c: F.coalesce(F.sum(of(c)), F.lit(0))
    d = full.agg(
        F.count(of(F.lit(1))).alias("num_samples"),
        F.count(F.when(F.col("_empty"), 1)).alias("skipped_empty"),
        total(n).alias("n_tokens"),
        F.coalesce(F.max(of(n)), F.lit(0)).alias("max_length"),
        F.coalesce(F.max(of(depth)), F.lit(0)).alias("max_morph_depth"),
        total(F.size(F.filter("ids", lambda x: x == unk))).alias("n_unk"),
        total(F.size(F.filter("labels", lambda x: x != IGNORE))).alias("n_supervised"),
        total((F.size("labels") != n).cast("int")).alias("n_misaligned"),
    )
    share = lambda c: F.when(F.col("n_tokens") > 0, F.col(c) / F.col("n_tokens")).otherwise(0.0)
    d = d.withColumn("avg_length", F.when(F.col("num_samples") > 0, F.col("n_tokens") / F.col("num_samples")).otherwise(0.0))
    d = d.withColumn("unk_rate", share("n_unk")).withColumn("supervised_rate", share("n_supervised"))
    return d.withColumn("passed", (F.col("num_samples") > 0) & (F.col("n_misaligned") == 0) & (F.col("unk_rate") <= max_unk) & (F.col("supervised_rate") >= min_supervised))


def positions_from_offsets(tokens: DataFrame, row: str = "doc_id", position: str = "pos") -> DataFrame:
    """word_pos and morph_depth of tokens (start, end) whose tracks aren't known: a word goes on where a token starts at the end of the one before."""
    return word_positions(tokens.withColumn("track", F.lit("general")), row, position).drop("track")


def positions_from_boundaries(tokens: DataFrame, word_id: int, morpheme_id: int, specials: tuple[int, int] = (0, 256), max_depth: int | None = None, row: str = "doc_id", position: str = "pos") -> DataFrame:
    """Adds word_pos and morph_depth to tokens (id) by their boundary ids, as running counts over a row.

    A word boundary opens a word; content before the first one belongs to word 0. A morpheme boundary goes one deeper. Other specials
    end the depth and stand at the current word. Depths stay under ``max_depth`` where it is positive.
    """
    w = Window.partitionBy(row).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    token = F.col("id")
    special = (token >= specials[0]) & (token < specials[1])
    opens, deeper = special & (token == word_id), special & (token == morpheme_id)
    d = tokens.withColumns({"_opens": opens.cast("int"), "_resets": special & ~deeper, "_deeper": deeper.cast("int"), "_content": ~special})
    d = d.withColumns({"_words": F.sum("_opens").over(w), "_run": F.sum(F.col("_resets").cast("int")).over(w)})
    # content in front of the first boundary is word 0 by itself
    early = F.max(F.when(F.col("_content") & (F.col("_words") == 0), 1).otherwise(0)).over(w)
    depth = F.sum("_deeper").over(Window.partitionBy(row, "_run").orderBy(position).rowsBetween(Window.unboundedPreceding, 0))
    # the first content of all, where no word is open, ends the depth as a boundary does
    d = d.withColumns({"_early": early, "_depth": depth})
    before = F.sum(F.when((F.col("_words") == 0) & (F.col("_early") == 0), F.col("_deeper")).otherwise(0)).over(Window.partitionBy(row, "_run").orderBy(position).rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_depth", F.when((F.col("_words") == 0) & (F.col("_early") == 1), F.col("_depth") - before).otherwise(F.col("_depth")))
    at = F.greatest(F.col("_words") - 1 + F.col("_early"), F.lit(0)).cast("int")
    deep = F.when(F.col("_resets"), 0).otherwise(F.col("_depth")).cast("int")
    if max_depth is not None and max_depth > 0:
        deep = F.least(deep, F.lit(max_depth - 1))
    return d.withColumns({"word_pos": at, "morph_depth": deep}).drop("_opens", "_resets", "_deeper", "_content", "_words", "_run", "_early", "_depth")


_TRACKS = StructType([StructField(n, ArrayType(IntegerType())) for n in ("word_pos", "morph_depth")])


def _tracks(at: np.ndarray, ids: pa.Array, word_id: int, morpheme_id: int, specials: tuple[int, int], max_depth: int | None) -> tuple[np.ndarray, np.ndarray]:
    """word_pos and morph_depth of all ids, of which rows begin at ``at[:-1]``; as in ``positions_from_boundaries``."""
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    token = ids.fill_null(0).to_numpy(zero_copy_only=False)
    special = known & (token >= specials[0]) & (token < specials[1])
    opens, deeper = special & (token == word_id), special & (token == morpheme_id)
    resets, content = special & ~deeper, known & ~special
    sizes = np.diff(at)
    place = np.arange(len(token))
    begin = np.repeat(at[:-1], sizes)

    def counted(flags: np.ndarray, since: np.ndarray) -> np.ndarray:
        """How many are set from the place ``since`` on, up to and with each."""
        before = np.r_[0, np.cumsum(flags, dtype=np.int64)]
        return before[1:] - before[since]

    words = counted(opens, begin)
    early = counted(content & (words == 0), begin) > 0
    run = np.maximum(np.maximum.accumulate(np.where(resets, place, 0)), begin) if len(token) else place
    outside = (words == 0) & ~early
    depth = counted(deeper, run) - np.where((words == 0) & early, counted(deeper & outside, run), 0)
    depth[resets] = 0
    if max_depth is not None and max_depth > 0:
        np.minimum(depth, max_depth - 1, out=depth)
    return np.maximum(words - 1 + early, 0).astype(np.int32), depth.astype(np.int32)


def boundary_tracks(ids: Column, word_id: int, morpheme_id: int, specials: tuple[int, int] = (0, 256), max_depth: int | None = None) -> Column:
    """``positions_from_boundaries`` of an array of ids, as a struct of the arrays word_pos and morph_depth: within the row, so nothing is exploded or shuffled. No part of a lambda."""

    @F.arrow_udf(_TRACKS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for a, b in parts(batch) if len(batch) else ((0, 0),):
                lists = batch.slice(a, b - a)
                at, flat = list_places(lists)
                made = _tracks(at, flat, word_id, morpheme_id, specials, max_depth)
                yield pa.StructArray.from_arrays([lists_from(np.diff(at), x, lists.is_null()) for x in made], names=_TRACKS.names)

    return run(ids)


def span_cutoff(n: Column, spans: Column, limit: int) -> Column:
    """Where a row of n tokens is cut so that no span (start, end) is cut through: at the limit, or at the start of the span across it. Spans don't overlap."""
    across = F.get(F.filter(spans, lambda s: (s["start"] < limit) & (s["end"] > limit)), 0)["start"]
    return F.when(n <= limit, n).otherwise(F.coalesce(across, F.lit(limit))).cast("int")


def truncate_spans(rows: DataFrame, limit: int, columns: tuple[str, ...] = ("ids", "labels"), media: tuple[str, ...] = ()) -> DataFrame:
    """Cuts the columns of over-long rows (ids, spans, ...) in front of the span that the limit would cut through.

    Spans beyond the cut go, and with them as many of each media column from its end. Adds ``truncated``.
    """
    if limit <= 0:
        raise ValueError("the limit must be positive")
    d = rows.withColumn("_cut", span_cutoff(F.size("ids"), F.col("spans"), limit)).withColumn("truncated", F.size("ids") > limit)
    d = d.withColumn("spans", F.when(F.col("truncated"), F.filter("spans", lambda s: s["end"] <= F.col("_cut"))).otherwise(F.col("spans")))
    d = d.withColumns({c: F.slice(c, F.lit(1), F.col("_cut")) for c in columns})
    kept = F.size("spans")
    return d.withColumns({m: F.when(F.col("truncated"), F.slice(m, F.lit(1), kept)).otherwise(F.col(m)) for m in media}).drop("_cut")


def normalize_rows(rows: DataFrame, limit: int) -> DataFrame:
    """Rows (ids, and labels, mask, word_pos, morph_depth, has_media where they have them) as the trainer takes them.

    Missing labels are the ids, a missing mask is all ones, missing positions are those of the tokens, missing depths 0. Rows of text are cut to the limit; an over-long row with media raises.
    """
    n = F.size("ids")
    default = {"labels": F.col("ids"), "mask": F.array_repeat(F.lit(1), n), "word_pos": F.transform("ids", lambda x, k: k), "morph_depth": F.array_repeat(F.lit(0), n)}
    d = rows.withColumns({c: F.coalesce(c, v) if c in rows.columns else v for c, v in default.items()})
    if "has_media" in rows.columns:
        fits = F.when(F.col("has_media") & (n > limit), F.raise_error(F.concat(F.lit("a row with media is too long: "), n.cast("string"))).cast("int")).otherwise(limit)
    else:
        fits = F.lit(limit)
    return d.withColumn("_limit", fits).withColumns({c: F.slice(c, F.lit(1), F.col("_limit")) for c in ("ids", *default)}).drop("_limit")


def _collated(batches: Iterator[pa.RecordBatch], pad_id: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Padded batches from rows (batch, ids, labels) sorted by batch; one batch is held at a time."""
    key = schema.names[0]
    fills = {"ids": pad_id, "labels": IGNORE}

    def padded(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        sizes = pc.list_value_length(rows.column("ids"))
        none = sizes.is_null().to_numpy(zero_copy_only=False)
        n = pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        longest = int(n.max())
        real = np.flatnonzero(~none)

        def grid(column: str | None) -> pa.ListArray:
            """A list of ``longest`` cells for each row that isn't null: its values, and fills behind them."""
            cells = np.full((len(real), longest), fills.get(column, 0), dtype=schema.field(column or "mask").type.value_type.value_type.to_pandas_dtype())
            inside = np.arange(longest) < n[real, None]
            cells[inside] = 1 if column is None else rows.column(column).filter(pa.array(~none)).flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.where(none, 0, longest))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(cells.ravel()), mask=pa.array(none))
            return pa.ListArray.from_arrays(pa.array([0, len(n)], type=pa.int32()), lists)

        columns = [rows.column(key).slice(0, 1), grid("ids"), grid("labels"), grid(None)]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    held: list[pa.RecordBatch] = []
    for rows in batches:
        keys = rows.column(key).to_pylist()
        at = 0
        for k in range(len(keys)):
            if (held or k > at) and keys[k] != (keys[k - 1] if k else held[-1].column(key)[-1].as_py()):
                held.append(rows.slice(at, k - at))
                yield padded(held)
                held, at = [], k
        if at < len(keys):
            held.append(rows.slice(at))
    if held:
        yield padded(held)


def collate(rows: DataFrame, batch: str, pad_id: int, position: str = "doc_id", take: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, taken: StructType | None = None) -> DataFrame:
    """(batch, ids, labels, mask): the rows of each batch in order, padded to its longest; a null row stays null. A batch is small by its purpose.

    Rows cross the shuffle as they are and are padded behind it. Ids and labels of a row are as many. ``take`` is given each padded batch in the task that made it, as
    a trainer is, and returns rows of the schema ``taken``; so padding, which can be most of a batch, needn't leave the task.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = rows.select(F.col(batch), F.col(position).alias("_at"), "ids", "labels").repartition(n, batch).sortWithinPartitions(batch, "_at")
    schema = StructType([d.schema[batch]] + [StructField(c, ArrayType(d.schema[c].dataType)) for c in ("ids", "labels")] + [StructField("mask", ArrayType(ArrayType(IntegerType())))])
    arrow = to_arrow_schema(schema)
    made = lambda b: _collated(b, pad_id, arrow)
    return d.drop("_at").mapInArrow(made, schema) if take is None else d.drop("_at").mapInArrow(lambda b: map(take, made(b)), taken)


def pad(ids: Column, length: Column, value: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest(length - F.size(ids), F.lit(0))))
