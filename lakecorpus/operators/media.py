"""Media placeholders in texts: expansion to patches, and offsets of the expanded text taken back to the text as it was.

An expansion is a list of edits in order: which stretch of the text each placeholder was, and which stretch of the expanded text stands for it. Offsets follow from the last edit that begins
before them, so tokens of any tokenizer are mapped by their ends alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakecorpus.functions.batches import list_places, lists_of, parts

KINDS = ("image", "video")
#: An edit: kind, number among its kind, patches, and both stretches.
EDIT = "array<struct<kind:string,index:int,patches:int,start:int,end:int,out_start:int,out_end:int>>"


def _block(kind: Column, n: Column) -> Column:
    one = lambda part: F.concat(F.lit("<"), kind, F.lit(f"_{part}>"))
    return F.concat(one("start"), F.repeat(one("patch"), n), one("end"))


def expand(texts: DataFrame, image_patches: str = "image_patches", video_patches: str = "video_patches") -> DataFrame:
    """Adds expanded and edits to rows (text, image_patches, video_patches: how many patches each medium has, in order; a null number is one).

    A row with more or fewer media than placeholders raises; null lists are empty, a null text gives nulls.
    """
    given = {k: F.coalesce(F.col(c).cast("array<int>"), F.array().cast("array<int>")) if c in texts.columns else F.array().cast("array<int>") for k, c in zip(KINDS, (image_patches, video_patches), strict=True)}
    d = texts.withColumn("_parts", F.split("text", "<(?:image|video)>", -1)).withColumn("_kinds", F.regexp_extract_all("text", F.lit("<(image|video)>"), F.lit(1)))
    d = d.withColumns({f"_{k}": given[k] for k in KINDS})
    of = lambda k: F.size(F.filter("_kinds", lambda x: x == k))
    wrong = (of("image") != F.size("_image")) | (of("video") != F.size("_video"))
    d = d.withColumn("_kinds", F.when(wrong, F.raise_error(F.lit("placeholders and media differ in number")).cast("array<string>")).otherwise(F.col("_kinds")))
    edit = EDIT[len("array<") : -1]
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("out"), F.lit(0).alias("image"), F.lit(0).alias("video"), F.array().cast(EDIT).alias("edits"))

    def add(s: Column, x: Column) -> Column:
        kind, before = x["kind"], F.length(x["before"])
        index = F.when(kind == "image", s["image"]).otherwise(s["video"])
        n = F.coalesce(F.when(kind == "image", F.get("_image", s["image"])).otherwise(F.get("_video", s["video"])), F.lit(1))
        start, out = s["at"] + before, s["out"] + before
        end, out_end = start + F.length(kind) + 2, out + F.length(_block(kind, n))
        new = F.struct(kind.alias("kind"), index.alias("index"), n.alias("patches"), start.alias("start"), end.alias("end"), out.alias("out_start"), out_end.alias("out_end")).cast(edit)
        return F.struct(end.alias("at"), out_end.alias("out"), (s["image"] + (kind == "image").cast("int")).alias("image"), (s["video"] + (kind == "video").cast("int")).alias("video"), F.concat(s["edits"], F.array(new)).alias("edits"))

    places = F.zip_with(F.slice("_parts", F.lit(1), F.size("_kinds")), "_kinds", lambda p, k: F.struct(p.alias("before"), k.alias("kind")))
    d = d.withColumn("edits", F.aggregate(places, begin, add, lambda s: s["edits"]))
    blocks = F.transform("edits", lambda e: _block(e["kind"], e["patches"]))
    d = d.withColumn("_blocks", blocks)
    whole = F.array_join(F.transform("_parts", lambda p, i: F.concat(p, F.coalesce(F.get("_blocks", i), F.lit("")))), "")
    return d.withColumn("expanded", whole).drop("_parts", "_kinds", "_image", "_video", "_blocks")


def source_offset(offset: Column, edits: Column) -> Column:
    """The place in the text of a place in the expanded text; within a block it is the end of the placeholder. -1 stays."""
    before = F.filter(edits, lambda e: e["out_start"] < offset)
    last = F.get(before, F.size(before) - 1)
    return F.when(offset < 0, offset).when(last.isNull(), offset).when(offset <= last["out_end"], last["end"]).otherwise(offset - last["out_end"] + last["end"])


def annotate(tokens: DataFrame, edits: DataFrame, row: str = "doc_id", position: str = "pos") -> DataFrame:
    """Tokens (row, position, token, start, end) of expanded texts with offsets in the texts as they were, and image_index and video_index, null for tokens of no medium.

    Marks and patches of a medium have the offsets of its placeholder. ``edits`` has row and edits. Both ends of each token and the edits of its row stand in one order, in which each end sees the
    last edit before it: a sort, whatever the number of edits. Tokens with offsets of -1 stay as they are.
    """
    of_row = Window.partitionBy(row).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    marks = edits.select(row, F.explode("edits").alias("_edit")).select(row, F.col("_edit.out_start").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_pos"), F.lit(None).cast("int").alias("_end"), "_edit")
    ends = F.array(F.struct(F.col("start").alias("at"), F.lit(0).alias("end")), F.struct(F.col("end").alias("at"), F.lit(1).alias("end")))
    points = tokens.select(row, F.col(position).cast("long").alias("_pos"), F.explode(ends).alias("_p")).select(row, F.col("_p.at").alias("_at"), F.lit(0).alias("_kind"), "_pos", F.col("_p.end").alias("_end"), F.lit(None).cast(EDIT[len("array<") : -1]).alias("_edit"))
    seen = points.union(marks).withColumn("_last", F.last("_edit", ignorenulls=True).over(of_row)).where(F.col("_kind") == 0)
    e, at = F.col("_last"), F.col("_at")
    inside = at <= e["out_end"]
    back = F.when((at < 0) | e.isNull(), at).when(inside, e["end"]).otherwise(at - e["out_end"] + e["end"])
    mapped = seen.groupBy(row, "_pos").agg(*[F.max(F.when(F.col("_end") == k, back)).alias(n) for k, n in enumerate(("_start", "_stop"))], F.max(F.when((F.col("_end") == 1) & inside, e)).alias("_own"))
    d = tokens.join(mapped, (tokens[row].eqNullSafe(mapped[row])) & (tokens[position] == mapped["_pos"]), "left").drop(mapped[row])
    for k in KINDS:
        mine = F.col("token").isin(*[f"<{k}_{p}>" for p in ("start", "patch", "end")]) & (F.col("_own.kind") == k)
        d = d.withColumn(f"{k}_index", F.when(mine, F.col("_own.index")))
    own = F.col("image_index").isNotNull() | F.col("video_index").isNotNull()
    moved = {"start": F.when(own, F.col("_own.start")).otherwise(F.col("_start")), "end": F.when(own, F.col("_own.end")).otherwise(F.col("_stop"))}
    return d.withColumns(moved).drop("_pos", "_start", "_stop", "_own")


def media_spans(annotated: DataFrame, edits: DataFrame, row: str = "doc_id", position: str = "pos") -> DataFrame:
    """(row, kind, index, start, end): from which token to behind which each medium goes. One that lacks its tokens, or has another number of patches than its edit, raises."""
    each = None
    for k in KINDS:
        some = annotated.where(F.col(f"{k}_index").isNotNull()).select(row, F.lit(k).alias("kind"), F.col(f"{k}_index").alias("index"), F.col(position).alias("_at"), (F.col("token") == f"<{k}_patch>").alias("_patch"))
        each = some if each is None else each.union(some)
    found = each.groupBy(row, "kind", "index").agg(F.min("_at").alias("start"), (F.max("_at") + 1).alias("end"), F.count(F.when(F.col("_patch"), 1)).alias("_n"))
    due = edits.select(row, F.explode("edits").alias("e")).select(row, F.col("e.kind").alias("kind"), F.col("e.index").alias("index"), F.col("e.patches").alias("_due"))
    both = due.join(found, [row, "kind", "index"], "full")
    fits = (F.col("_n") == F.col("_due")) & (F.col("end") - F.col("start") == F.col("_due") + 2)
    at = F.when(F.coalesce(fits, F.lit(False)), F.col("start")).otherwise(F.raise_error(F.lit("the tokens of a medium don't match its placeholder")).cast("long"))
    return both.select(row, "kind", "index", at.alias("start"), "end")


#: Marks, words and white space of expanded texts.
MARKS = r"<(?:image|video)_(?:start|patch|end)>|[^ \t\r\n\f\x0b<]+|<|[ \t\r\n\f\x0b]+"
_WORD = pa.struct([("token", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_ANNOTATED = pa.struct([*_WORD, ("image_index", pa.int32()), ("video_index", pa.int32())])
_PLACED = pa.struct([("kind", pa.string()), ("index", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])


def _words(texts: pa.Array) -> pa.Array:
    each = [[(m[0], m.start(), m.end()) for m in re.finditer(MARKS, t or "") if m[0][0] not in " \t\r\n\f\x0b"] for t in texts.to_pylist()]
    return lists_of([len(x) for x in each], list(zip(*(w for x in each for w in x), strict=True)) or [()] * 3, _WORD)


def _numbers(values: pa.Array, name: str) -> np.ndarray:
    return pc.fill_null(pc.struct_field(values, name), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _text_is(values: pa.Array, name: str, *some: str) -> np.ndarray:
    return pc.is_in(pc.struct_field(values, name), value_set=pa.array(some)).to_numpy(zero_copy_only=False)


def _annotated(tokens: pa.Array, edits: pa.Array) -> pa.Array:
    (t_at, t), (e_at, e) = list_places(tokens), list_places(edits)
    row, e_row = (np.repeat(np.arange(len(at) - 1), np.diff(at)) for at in (t_at, e_at))
    start, end, out_start, out_end = (_numbers(e, n) for n in ("start", "end", "out_start", "out_end"))
    order = (e_row << 33) + out_start

    def last(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last edit of the row that begins before a place, and whether there is one."""
        k = np.searchsorted(order, (row << 33) + at, side="left") - 1
        there = (at >= 0) & (k >= e_at[row])
        return np.where(there, k, 0), there

    def back(at: np.ndarray) -> np.ndarray:
        if not len(e):
            return at
        k, there = last(at)
        return np.where(there, np.where(at <= out_end[k], end[k], at - out_end[k] + end[k]), at)

    ends = {n: _numbers(t, n) for n in ("start", "end")}
    moved = {n: back(at) for n, at in ends.items()}
    index = {}
    for kind in KINDS:
        mine = np.zeros(len(t), dtype=bool)
        if len(e):
            k, there = last(ends["end"])
            mine = there & (ends["end"] <= out_end[k]) & _text_is(e, "kind", kind)[k] & _text_is(t, "token", *[f"<{kind}_{p}>" for p in ("start", "patch", "end")])
            moved = {"start": np.where(mine, start[k], moved["start"]), "end": np.where(mine, end[k], moved["end"])}
        numbers = _numbers(e, "index")[k] if len(e) else np.zeros(len(t), dtype=np.int64)
        index[kind] = pa.array(numbers, type=pa.int32(), mask=~mine)
    return lists_of(np.diff(t_at), [pc.struct_field(t, "token"), moved["start"], moved["end"], index["image"], index["video"]], _ANNOTATED)


def _placed(tokens: pa.Array, edits: pa.Array) -> pa.Array:
    (t_at, t), (e_at, e) = list_places(tokens), list_places(edits)
    row = np.repeat(np.arange(len(t_at) - 1), np.diff(t_at))
    place = np.arange(len(t)) - t_at[row]
    first, behind, patches = np.full(len(e), np.iinfo(np.int64).max), np.zeros(len(e), dtype=np.int64), np.zeros(len(e), dtype=np.int64)
    fits = True
    for kind in KINDS:
        of_kind = _text_is(e, "kind", kind) if len(e) else np.zeros(0, dtype=bool)
        ids, before = np.flatnonzero(of_kind), np.r_[0, np.cumsum(of_kind)]
        index = _numbers(t, f"{kind}_index")
        some = np.flatnonzero(index >= 0)
        at = before[e_at[row[some]]] + index[some]
        fits = fits and bool((at < before[e_at[row[some] + 1]]).all())
        if fits:
            mine = ids[at]
            np.minimum.at(first, mine, place[some])
            np.maximum.at(behind, mine, place[some] + 1)
            patches += np.bincount(mine[_text_is(t, "token", f"<{kind}_patch>")[some]], minlength=len(e)) if len(e) else 0
    due = _numbers(e, "patches")
    if not fits or ((patches != due) | (behind - first != due + 2)).any():
        raise ValueError("the tokens of a medium don't match its placeholder")
    return lists_of(np.diff(e_at), [pc.struct_field(e, "kind"), pc.struct_field(e, "index"), first, behind], _PLACED)


def in_rows(text: Column, edits: Column) -> Column:
    """What ``annotate`` and ``media_spans`` make of the tokens of ``tokenized``, in the text's own row: no token leaves its row, so nothing is shuffled.

    A struct of tokens (token, start, end, image_index, video_index) in order, and spans (kind, index, start, end), one for each edit.
    """

    @F.arrow_udf("tokens array<struct<token:string,start:int,end:int,image_index:int,video_index:int>>, spans array<struct<kind:string,index:int,start:long,end:long>>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for t, e in batches:
            for a, b in parts(t) if len(t) else ((0, 0),):
                mine = e.slice(a, b - a)
                tokens = _annotated(_words(t.slice(a, b - a)), mine)
                yield pa.StructArray.from_arrays([tokens, _placed(tokens, mine)], names=["tokens", "spans"])

    return run(text, edits)


def tokenized(texts: DataFrame, row: str = "doc_id", text: str = "expanded") -> DataFrame:
    """(row, pos, token, start, end) of marks and words between spaces: a plain tokenizer of expanded texts, for tests and counts."""
    found = texts.select(row, F.regexp_extract_all(text, F.lit(MARKS), F.lit(0)).alias("t"))
    each = found.select(row, F.posexplode("t").alias("_i", "token"))
    w = Window.partitionBy(row).orderBy("_i")
    ends = each.withColumn("end", F.sum(F.length("token")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    words = ends.withColumn("start", (F.col("end") - F.length("token")).cast("int")).where(F.col("token").rlike(r"[^ \t\r\n\f\x0b]"))
    return words.select(row, (F.row_number().over(w) - 1).cast("long").alias("pos"), "token", "start", "end")
