"""Box tokens and media placeholders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakecorpus.functions.metrics import bound


def bin_of(value: Column, size: Column, bins: int = 1000) -> Column:
    """The bin of a coordinate, rounded half to even; outside values go to the edge."""
    share = F.least(F.greatest(value / size, F.lit(0.0)), F.lit(1.0))
    return F.least(F.bround(share * (bins - 1)), F.lit(bins - 1)).cast("int")


def box_token(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, bins: int = 1000) -> Column:
    """``<bbox_x0_y0_x1_y1>`` with three digits each; null for a box that is inside out or a size that isn't positive."""
    ok = (width > 0) & (height > 0) & (x0 <= x1) & (y0 <= y1)
    parts = [bin_of(x0, width, bins), bin_of(y0, height, bins), bin_of(x1, width, bins), bin_of(y1, height, bins)]
    return F.when(ok, F.format_string("<bbox_%03d_%03d_%03d_%03d>", *parts))


def box_of(token: Column, width: Column, height: Column, bins: int = 1000) -> Column:
    """(x0, y0, x1, y1) of a token; null for another string."""
    found = token.rlike(r"^<bbox_\d+_\d+_\d+_\d+>$")
    part = lambda k: F.regexp_extract(token, r"^<bbox_(\d+)_(\d+)_(\d+)_(\d+)>$", k).cast("int") / (bins - 1)
    sides = {"x0": (1, width), "y0": (2, height), "x1": (3, width), "y1": (4, height)}
    return F.when(found, F.struct(*[(part(k) * size).alias(n) for n, (k, size) in sides.items()]))


def patches(width: Column, height: Column, patch: int = 14, merge: int = 2) -> Column:
    """Merged patches of an image."""
    side = patch * merge
    return (F.ceil(width / side) * F.ceil(height / side)).cast("int")


def expand_placeholders(text: Column, counts: Column, name: str = "image") -> Column:
    """Puts each image's start, patches and end where its placeholder stands; raises if there are more or fewer counts."""
    parts = F.split(text, f"<{name}>", -1)
    blocks = F.transform(counts, lambda n: F.concat(F.lit(f"<{name}_start>"), F.repeat(F.lit(f"<{name}_patch>"), n), F.lit(f"<{name}_end>")))
    joined = bound(blocks, lambda bs: F.array_join(F.transform(parts, lambda p, i: F.concat(F.when(i == 0, "").otherwise(F.get(bs, i - 1)), p)), ""))
    return F.when(F.size(parts) - 1 == F.size(counts), joined).otherwise(F.raise_error(F.lit("placeholders and sizes differ in number")).cast("string"))
