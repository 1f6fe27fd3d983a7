"""Checks of encoded rows before training: every broken rule of every row, as rows themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .training_rows import IGNORE

FAILURE = "array<struct<rule:string,at:int>>"
#: Names of the aligned arrays of a row besides ids, which may be missing from a table.
ALIGNED = ("labels", "mask", "offsets", "word_pos", "morph_depth")
#: Metadata that is kept of a source row (fixed values).
METADATA = ("type", "ocr", "images", "image_sizes", "videos", "video_sizes", "source", "id")


def _at_each(values: Column, bad, rule: str) -> Column:
    """A failure for each element that is bad, with its place."""
    found = F.filter(F.transform(values, lambda v, k: F.when(bad(v), F.struct(F.lit(rule).alias("rule"), k.cast("int").alias("at")))), lambda f: f.isNotNull())
    return F.coalesce(found, F.array().cast(FAILURE)).cast(FAILURE)


def _once(bad: Column, rule: str) -> Column:
    one = F.array(F.struct(F.lit(rule).alias("rule"), F.lit(-1).alias("at"))).cast(FAILURE)
    return F.when(bad, one).otherwise(F.array().cast(FAILURE))


def failures(rows: DataFrame, vocabulary_size: int, position: str = "doc_id", n_chars: str | None = None, media: dict[str, tuple[str, int, int]] | None = None) -> DataFrame:
    """(position, rule, at): what is wrong with each row of ids and those of ALIGNED that the table has; at is the token or span, -1 for the whole row.

    Arrays have the length of ids; ids and labels lie in the vocabulary (a label may be ignored); offsets (start, end) are (-1, -1)
    or lie in order inside a text of ``n_chars``; positions and depths aren't negative. ``media`` names columns of spans (start, end) with the column of
    their payloads and their opening and closing ids: a span lies in the row, begins and ends with its ids, has no label, and there are as many payloads as spans.
    """
    there = [c for c in ALIGNED if c in rows.columns]
    n = F.size("ids")
    outside = lambda v: (v < 0) | (v >= vocabulary_size)
    found = [_once(F.size(c) != n, f"{c}_length") for c in there]
    found.append(_at_each(F.col("ids"), outside, "id_range"))
    if "labels" in there:
        found.append(_at_each(F.col("labels"), lambda v: (v != IGNORE) & outside(v), "label_range"))
    if "offsets" in there:
        end = F.col(n_chars) if n_chars else F.lit(None).cast("int")
        wrong = lambda o: ~((o["start"] == -1) & (o["end"] == -1)) & ((o["start"] < 0) | (o["end"] < o["start"]) | F.coalesce(o["end"] > end, F.lit(False)))
        found.append(_at_each(F.col("offsets"), wrong, "offset"))
    found += [_at_each(F.col(c), lambda v: v < 0, f"negative_{c}") for c in ("word_pos", "morph_depth") if c in there]
    for spans, (payload, opening, closing) in (media or {}).items():
        found.append(_at_each(F.col(spans), lambda s: ~_inside(n, s), f"{spans}_bounds"))
        found.append(_at_each(F.col(spans), _short(n), f"{spans}_short"))
        found.append(_at_each(F.col(spans), _unmarked(n, opening, closing), f"{spans}_markers"))
        if "labels" in there:
            found.append(_at_each(F.col(spans), _labelled(n), f"{spans}_labelled"))
        found.append(_once(F.size(payload) != F.size(spans), f"{payload}_count"))
    return rows.select(position, F.explode(F.concat(*found)).alias("f")).select(position, "f.rule", "f.at")


def _inside(n: Column, s: Column) -> Column:
    return (s["start"] >= 0) & (s["end"] <= n) & (s["end"] > s["start"])


def _short(n: Column):
    return lambda s: _inside(n, s) & (s["end"] - s["start"] < 2)


def _unmarked(n: Column, opening: int, closing: int):
    return lambda s: _inside(n, s) & (s["end"] - s["start"] >= 2) & ((F.get("ids", s["start"]) != opening) | (F.get("ids", s["end"] - 1) != closing))


def _labelled(n: Column):
    return lambda s: _inside(n, s) & (s["end"] - s["start"] >= 2) & F.exists(F.slice("labels", s["start"] + 1, s["end"] - s["start"]), lambda v: v != IGNORE)


def failure_counts(found: DataFrame, position: str = "doc_id") -> DataFrame:
    """(rule, n_rows, n_failures) of failures."""
    each = found.groupBy("rule", position).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("rule").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n").cast("long").alias("n_failures"))


def metadata(values: Column) -> Column:
    """The known keys of a map of metadata; without a type it is text."""
    kept = F.map_filter(values, lambda k, _: k.isin(*METADATA))
    return F.when(F.map_contains_key(kept, "type"), kept).otherwise(F.map_concat(kept, F.create_map(F.lit("type"), F.lit("text"))))


def nested(flat: Column) -> Column:
    """A flat array as an array of one array; null and empty give an empty one."""
    return F.when(F.coalesce(F.size(flat), F.lit(0)) > 0, F.array(flat)).otherwise(F.array().cast("array<array<int>>"))


def continuation(ids: Column, eos: int, pad: int) -> Column:
    """Generated ids up to the first end token, without padding."""
    at = F.array_position(ids, eos)
    return F.filter(F.when(at > 0, F.slice(ids, F.lit(1), (at - 1).cast("int"))).otherwise(ids), lambda x: x != pad)


def json_number(value: Column) -> Column:
    """A number that JSON can hold; null for NaN and infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def with_media(rows: DataFrame, column: str = "images") -> DataFrame:
    """Rows that have any."""
    return rows.where(F.coalesce(F.size(column), F.lit(0)) > 0)


def filled(rows: DataFrame, *keys: str, column: str = "ids") -> tuple[DataFrame, DataFrame]:
    """The rows with anything in the column, and (keys, n_rows, n_empty) of all."""
    empty = F.coalesce(F.size(column), F.lit(0)) <= 0
    return rows.where(~empty), rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(empty, 1)).alias("n_empty"))


def within(rows: DataFrame, longest: int, column: str = "text") -> DataFrame:
    """Rows whose text isn't too long for what comes next; null texts go."""
    return rows.where(F.length(column) <= longest)


def tokens_per_step(micro_batch: int, accumulated: int, length: int, ranks: int) -> int:
    return micro_batch * accumulated * length * ranks
