"""Chat formatting by token-level assembly.

Each turn's role and text are encoded on their own, so no token spans a boundary, and reserved ids, which no text can
produce, are spliced in between. The loss mask is a prefix sum over marks: +1 where a supervised text begins, -1 where it ends. Control strings
occurring in a role or text are escaped reversibly, so the formatted string reads back as well.

A conversation of T turns is T + 1 rows (a row with the opening id, then the turns), so that a conversation of any length
stays within bounded rows; sorted by (conv_id, seq) their ids joined are the training row.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType

#: The template's own markers, in the order of their reserved ids (fixed values).
OPEN, END, ROLE, TEXT = MARKERS = ("<s>", "</s>", "[ROLE]", "[/ROLE]")
#: Strings with a meaning in this or other common templates (fixed values). Their second to last characters follow an escape.
CONTROL = (*MARKERS, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_REST = "|".join(re.escape(c[1:]) for c in sorted(CONTROL, key=len, reverse=True))
_ESCAPE = re.compile(rf"([<\[])(\\*)({_REST})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)({_REST})")
#: Splits text before the merges, as the rank files of byte-level vocabularies have it (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class ChatConfig:
    #: File of ranks (base64 token, rank on each line); it must be there on every executor.
    ranks: str
    supervised: tuple[str, ...] = field(default=("assistant",))


def escape(text: str) -> str:
    """Puts one more backslash behind the first character of each control string, so none is left."""
    return _ESCAPE.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


@functools.lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def reserved(path: str) -> dict[str, int]:
    """The markers' ids: those after the vocabulary and one free id."""
    first = encoding(path).max_token_value + 2
    return {m: first + k for k, m in enumerate(MARKERS)}


def _formatted(batches: Iterator[pa.RecordBatch], config: ChatConfig) -> Iterator[pa.RecordBatch]:
    enc, ids = encoding(config.ranks), reserved(config.ranks)
    for batch in batches:
        roles = [r or "" for r in batch.column("role").to_pylist()]
        texts = [t or "" for t in batch.column("text").to_pylist()]
        opening = batch.column("opening").to_pylist()
        parts: list[list[int]] = []
        marks: list[tuple[int, int]] = []
        rows = []
        n = 0
        for role, text, opens in zip(roles, texts, opening, strict=True):
            if opens:
                turn = [[ids[OPEN]]]
            else:
                turn = [[ids[ROLE]], enc.encode_ordinary(escape(role)), [ids[TEXT]], enc.encode_ordinary(escape(text)), [ids[END]]]
                if role in config.supervised:
                    begin = n + sum(map(len, turn[:3]))
                    marks.append((begin, begin + len(turn[3])))
            parts += turn
            rows.append(sum(map(len, turn)))
            n += rows[-1]
        flat = np.fromiter((x for p in parts for x in p), dtype=np.int32, count=n)
        change = np.zeros(n + 1, dtype=np.int64)
        for a, b in marks:
            change[a] += 1
            change[b] -= 1
        mask = np.cumsum(change)[:n] > 0
        ends = pa.array(np.cumsum([0, *rows]), type=pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(flat)), pa.ListArray.from_arrays(ends, pa.array(mask))]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("seq"), *lists], names=["conv_id", "seq", "ids", "loss"])


def format_chat(conversations: DataFrame, config: ChatConfig) -> DataFrame:
    """(conv_id, seq, ids, loss): a row for the opening of each conversation and one for each turn.

    seq orders a conversation's rows: nothing, then turn, role and text (nulls first); equal rows are interchangeable. Null roles and texts are empty.
    A null conv_id is a conversation like others. Other columns are ignored. An empty table gives an empty result.
    """
    seq = lambda opens: F.struct(F.lit(opens).alias("turns"), *[F.col(c) for c in ("turn", "role", "text")])
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    first = turns.select("conv_id").distinct().select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    rows = first.select("conv_id", seq(0).alias("seq"), "role", "text", F.lit(True).alias("opening")).union(turns.select("conv_id", seq(1).alias("seq"), "role", "text", F.lit(False).alias("opening")))
    schema = rows.select("conv_id", "seq").schema.add("ids", ArrayType(IntegerType())).add("loss", ArrayType(BooleanType()))
    return rows.mapInArrow(lambda b: _formatted(b, config), schema)


class _Reader:
    """Reads the ids of one conversation, turn after turn, and digests what it finds."""

    def __init__(self, config: ChatConfig):
        self.enc, self.ids = encoding(config.ranks), reserved(config.ranks)
        self.turns = self.loss_chars = self.chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def _text(self, ids: np.ndarray) -> str:
        return self.enc.decode_bytes(ids.tolist()).decode("utf-8")

    def read(self, ids: np.ndarray, loss: np.ndarray) -> None:
        at = np.flatnonzero(ids >= self.ids[OPEN])
        kinds = [MARKERS[k] for k in ids[at] - self.ids[OPEN]]
        self.chars += sum(map(len, kinds))
        if kinds == [OPEN]:
            return
        if kinds != [ROLE, TEXT, END]:
            raise ValueError(f"not a turn: {kinds}")
        role, text = (self._text(ids[a + 1 : b]) for a, b in zip(at[:-1], at[1:], strict=True))
        self.chars += len(role) + len(text)
        self.turns += 1
        self.all.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
        supervised = unescape(self._text(ids[loss]))
        self.loss_chars += len(supervised)
        self.loss.update(supervised.encode())


def digests(formatted: DataFrame, config: ChatConfig) -> DataFrame:
    """For each conversation what its ids and mask read back as: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A task streams the sorted rows and holds one turn at a time, however long a conversation is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader, out = None, None, []

        def row():
            return {"conv_id": now, "n_turns": reader.turns, "turns_sha256": reader.all.hexdigest(), "loss_chars": reader.loss_chars, "loss_sha256": reader.loss.hexdigest(), "formatted_chars": reader.chars}

        types = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        for batch in batches:
            for conv, ids, loss in zip(batch.column("conv_id").to_pylist(), batch.column("ids"), batch.column("loss"), strict=True):
                if reader is None or conv != now:
                    if reader:
                        out.append(row())
                    now, reader = conv, _Reader(config)
                reader.read(ids.values.to_numpy(), loss.values.to_numpy(zero_copy_only=False))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema=types)
                out = []
        if reader:
            out.append(row())
        yield pa.RecordBatch.from_pylist(out, schema=types)

    rows = formatted.withColumn("conv_id", F.col("conv_id").cast("long"))
    n = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "seq").select("conv_id", "ids", "loss")
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

