"""Arrow batches in parts of bounded size, and columns of lists made from flat ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Bytes of texts, or elements of lists, that are worked on together; a longer value stands alone.
PART = 1 << 18


def parts(values: pa.Array, most: int = PART) -> Iterator[tuple[int, int]]:
    """Ranges [from, to) of texts or lists, in order; each has little more than ``most`` bytes or elements. An empty array has none."""
    size = pc.list_value_length(values) if pa.types.is_list(values.type) or pa.types.is_large_list(values.type) else pc.binary_length(values)
    total = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    edges = [0, *(np.flatnonzero(np.diff(total // most)) + 1).tolist(), len(values)]
    yield from ((a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if a < b)


def in_parts(rows: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: StructType, column: str = "text") -> DataFrame:
    """What ``work`` makes of the rows, which it is given in parts by a column of texts or lists; all that it makes of a part on the way stays in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in parts(batch.column(column)):
                yield work(batch.slice(a, b - a))

    return rows.mapInArrow(run, schema)


def lists_of(sizes: list[int], columns: list, schema: pa.StructType) -> pa.ListArray:
    """One list of structs for each size, from the structs' fields in flat columns."""
    flat = pa.StructArray.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], fields=list(schema))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes, dtype=np.int64)].astype(np.int32)), flat)


def list_places(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where each list begins among all elements, with the end of the last one, and the elements; a null list is empty."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.r_[0, np.cumsum(sizes, dtype=np.int64)], lists.flatten()


def lists_from(sizes: np.ndarray, values: np.ndarray | pa.Array, none: pa.Array | None = None) -> pa.ListArray:
    """One list of values for each size; null where ``none`` marks it."""
    offsets = pa.array(np.r_[0, np.cumsum(sizes, dtype=np.int64)].astype(np.int32))
    return pa.ListArray.from_arrays(offsets, values if isinstance(values, pa.Array) else pa.array(values), mask=none)


def places(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``begin``, ``begin`` + 1, ... of each range of so many, one range behind the other."""
    return np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def cut_lists(lists: pa.Array, begin: np.ndarray | int, most: np.ndarray | int) -> pa.ListArray:
    """Of each list at most so many elements from ``begin`` on; null stays null."""
    at, flat = list_places(lists)
    first = np.minimum(at[:-1] + begin, at[1:])
    sizes = np.minimum(at[1:] - first, most)
    return lists_from(sizes, flat.take(pa.array(places(first, sizes))), lists.is_null())


def utf8_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes of UTF-8 each text has, and all bytes; a null text has none."""
    plain = pc.fill_null(texts, "")
    sizes = pc.binary_length(plain).to_numpy(zero_copy_only=False).astype(np.int64)
    data = plain.buffers()[2]
    if data is None or not sizes.sum():
        return sizes, np.zeros(0, dtype=np.uint8)
    begin = int(np.frombuffer(plain.buffers()[1], dtype=np.int64 if pa.types.is_large_string(plain.type) else np.int32)[plain.offset])
    return sizes, np.frombuffer(data, dtype=np.uint8)[begin : begin + int(sizes.sum())]
