"""Operators around tokens: spans by script, byte fallback, incremental decoding, frequencies, vocabularies, OCR rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from lakecorpus.functions.batches import cut_lists, list_places, lists_from, lists_of, parts, places

from .training_rows import IGNORE

#: The traditional script with its marks, its punctuation (which is no part of words), and the spaces (fixed values).
SCRIPT = "\u1800-᢯\U00011660-\U0001167f"
PUNCTUATION = "\u1800-\u1809"
SPACES = " \u00a0\u202f"
#: What breaks tracks besides scripts (fixed values).
SPECIALS = ("<pad>", "<unk>", "<bos>", "<eos>", "<img>", "<image>", "<video>", "<audio>", "<bbox>", "<ocr>", "<doc>", "<table>", "<layout>")


def span_pattern(specials: Iterable[str] = SPECIALS) -> re.Pattern:
    """Spans as groups: special tokens (the longest first), words of the script with narrow spaces inside, spaces, all else.

    Characters with which none of the first three can begin are taken together, the others looked at one by one.
    """
    specials = list(specials)
    special = "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) or "(?!)"
    inner = f"(?<=[{SCRIPT}])\u202f(?=[{SCRIPT}])"
    word = f"(?:(?![{PUNCTUATION}])[{SCRIPT}]|{inner})"
    space = f"(?:(?!{inner})[{SPACES}])"
    return re.compile(f"(?P<special>{special})|(?P<mn>(?:(?!{special}){word})+)|(?P<space>(?:(?!{special}){space})+)|(?P<general>(?:{plain_characters(specials)}+|(?!{special}|{word}|{space}).)+)", re.S)


def plain_characters(specials: Iterable[str]) -> str:
    return f"[^{SCRIPT}{SPACES}{''.join(sorted({re.escape(s[0]) for s in specials if s}))}]"


SPAN = StructType([StructField("lang", StringType()), StructField("text", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])


def spans(text: str | None, pattern: re.Pattern) -> list[tuple[str, str, int, int]]:
    return [(m.lastgroup, m[0], m.start(), m.end()) for m in pattern.finditer(text or "")]


def segment(text: Column, specials: tuple[str, ...] = SPECIALS) -> Column:
    """The spans of a text by track, as an array of (lang, text, start, end). They join to the text."""

    schema = pa.struct([("lang", pa.string()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    @F.arrow_udf(ArrayType(SPAN))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pattern = span_pattern(specials)
        for batch in batches:
            for a, b in parts(batch) if len(batch) else ((0, 0),):
                each = [spans(t, pattern) for t in batch.slice(a, b - a).to_pylist()]
                columns = list(zip(*(s for x in each for s in x), strict=True)) or [()] * 4
                yield lists_of([len(x) for x in each], columns, schema)

    return run(text)


def character_ids(text: Column, ids: dict[str, int], other: int) -> Column:
    """An id for each character: that of ``ids``, else ``other``. No part of a lambda."""
    table = np.full(max(map(ord, ids), default=0) + 2, other, dtype=np.int32)
    for c, i in ids.items():
        table[ord(c)] = i

    @F.arrow_udf(ArrayType(IntegerType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for a, b in parts(batch) if len(batch) else ((0, 0),):
                some = batch.slice(a, b - a)
                each = [t or "" for t in some.to_pylist()]
                codes = np.frombuffer("".join(each).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                yield lists_from(np.array([len(t) for t in each], dtype=np.int64), table[np.minimum(codes, len(table) - 1)], some.is_null())

    return run(text)


def track(piece: Column) -> Column:
    """``general`` for a piece with a letter or number, else ``general_punct``."""
    return F.when(piece.rlike(r"[\p{L}\p{N}]"), "general").otherwise("general_punct")


def encode_with_fallback(text: str, vocabulary: dict[str, int], unknown: int) -> list[int]:
    """An id for each character that is a token, and one for each byte of the others."""
    out = []
    for c in text:
        if c in vocabulary:
            out.append(vocabulary[c])
        else:
            out += [vocabulary.get(f"<0x{b:02X}>", unknown) for b in c.encode("utf-8", "surrogatepass")]
    return out


def decode_with_fallback(ids: Iterable[int], tokens: dict[int, str]) -> str:
    """Joins tokens; runs of byte tokens are decoded together, broken ones with replacement."""
    parts, held = [], bytearray()
    for i in ids:
        t = tokens.get(i, "")
        m = re.fullmatch("<0x([0-9A-F]{2})>", t)
        if m:
            held.append(int(m[1], 16))
            continue
        if held:
            parts.append(held.decode("utf-8", "replace"))
            held = bytearray()
        parts.append(t)
    return "".join(parts) + held.decode("utf-8", "replace")


def decode_stream(ids: Iterable[int], decode: Callable[[list[int]], str]) -> Iterator[str]:
    """What each id adds to the text for good: characters that a later id may still complete are held back, the rest comes at the end.

    The pieces join to the decoding of all ids. Only ids that aren't told yet and the one before them are decoded again, which
    suffices where a token's text depends at most on the one before it.
    """
    held: list[int] = []  # the last id that is told in full, and those after it
    told = ""
    for i in ids:
        held.append(i)
        text = decode(held)
        stable = text.rstrip("\ufffd")
        yield stable[len(told) :]
        if stable == text:
            held, told = held[-1:], decode(held[-1:])
        else:
            told = max(told, stable, key=len)
    if held:
        yield decode(held)[len(told) :]


def legacy_encoding(text: Column) -> Column:
    """``menksoft`` for private-use letters, ``mixed`` if there are standard ones as well, else ``unicode``."""
    old, new = text.rlike(r"[\x{e234}-\x{e34f}]"), text.rlike(f"[{SCRIPT}]")
    return F.when(old & new, "mixed").when(old, "menksoft").otherwise("unicode")


def standard_unicode(text: Column) -> Column:
    """Narrow spaces of suffixes as vowel separators, without zero-width characters; variation selectors stay."""
    return F.translate(text, "\u202f\u200b\u200c\u200d\u2060\ufeff", "\u180e")


def nominal_unicode(text: Column) -> Column:
    """As standard_unicode, and without variation selectors, so that forms of a letter are one."""
    return F.translate(standard_unicode(text), "\u180b\u180c\u180d\u180f", "")


def word_counts(docs: DataFrame, keep: str | None = None) -> DataFrame:
    """(word, n) of the words between spaces, or only of those that match ``keep``."""
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"[^ \t\r\n\f\x0b]+"), F.lit(0))).alias("word"))
    return (words.where(F.col("word").rlike(keep)) if keep else words).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def pair_counts(words: DataFrame) -> DataFrame:
    """(left, right, n) of neighbouring characters, taken from distinct words and weighted by their counts."""
    chars = words.select("n", F.split("word", "").alias("c")).where(F.size("c") > 1)
    pairs = chars.select("n", F.explode(F.arrays_zip(F.slice("c", F.lit(1), F.size("c") - 1).alias("left"), F.slice("c", F.lit(2), F.size("c") - 1).alias("right"))).alias("p"))
    return pairs.groupBy("p.left", "p.right").agg(F.sum("n").alias("n"))


def vocabulary_union(first: DataFrame, second: DataFrame, specials: DataFrame, first_at: tuple[int, int], second_at: tuple[int, int]) -> DataFrame:
    """(token, id): special ids stay, then each vocabulary (token, local_id) fills its own segment [from, to) in order.

    A token that is there already is left out. One that doesn't fit its segment raises.
    """

    def laid_out(vocabulary: DataFrame, taken: DataFrame, at: tuple[int, int]) -> DataFrame:
        new = vocabulary.join(taken.select("token"), "token", "left_anti")
        place = F.row_number().over(Window.orderBy("local_id", "token")) - 1 + at[0]
        fits = F.when(place < at[1], place).otherwise(F.raise_error(F.lit(f"the vocabulary overflows its segment {at}")).cast("int"))
        return new.select("token", fits.alias("id"))

    taken = specials.select("token", F.col("id").cast("int").alias("id"))
    one = laid_out(first, taken, first_at)
    both = taken.union(one)
    return both.union(laid_out(second, both, second_at))


def ocr_rows(rows: DataFrame, patches: int, bos: int, start: int, patch: int, end: int, eos: int) -> DataFrame:
    """Adds ids and labels to rows (instruction array<int>, target array<int>): image slots and instruction masked, target and end token supervised.

    Rows without a target are left out.
    """
    if patches < 1:
        raise ValueError("an image has at least one patch")
    prompt = F.concat(F.array(F.lit(bos), F.lit(start)), F.array_repeat(F.lit(patch), patches), F.array(F.lit(end)), "instruction")
    said = F.concat("target", F.array(F.lit(eos)))
    masked = F.array_repeat(F.lit(IGNORE), F.size("instruction") + patches + 3)
    return rows.where(F.size("target") > 0).withColumns({"ids": F.concat(prompt, said), "labels": F.concat(masked, said)})


def ocr_lists(instructions: pa.Array, targets: pa.Array, patches: int, bos: int, start: int, patch: int, end: int, eos: int) -> tuple[pa.ListArray, pa.ListArray]:
    """``ocr_rows`` in Arrow: ids and labels of rows whose targets are not empty. A null instruction counts as empty."""
    if patches < 1:
        raise ValueError("an image has at least one patch")
    image = np.array([bos, start, *[patch] * patches, end], dtype=np.int32)
    (asked_at, asked), (said_at, said) = list_places(instructions), list_places(targets)
    n_asked, n_said = np.diff(asked_at), np.diff(said_at)
    sizes = len(image) + n_asked + n_said + 1
    at = np.r_[0, np.cumsum(sizes)]
    ids, labels = np.empty(at[-1], dtype=np.int32), np.full(at[-1], IGNORE, dtype=np.int32)
    ids[at[:-1, None] + np.arange(len(image))] = image
    ids[places(at[:-1] + len(image), n_asked)] = asked.to_numpy(zero_copy_only=False)
    target = places(at[1:] - 1 - n_said, n_said)
    for x in (ids, labels):
        x[target] = said.to_numpy(zero_copy_only=False)
        x[at[1:] - 1] = eos
    return lists_from(sizes, ids), lists_from(sizes, labels)


def split_ocr_lists(ids: pa.Array, labels: pa.Array, eos: int) -> tuple[pa.ListArray, pa.ListArray]:
    """``split_ocr_rows`` in Arrow: prompts and targets."""
    at, flat = list_places(ids)
    masked_at, marks = list_places(labels)
    masked = np.diff(np.r_[0, np.cumsum(marks.to_numpy(zero_copy_only=False) == IGNORE, dtype=np.int64)][masked_at])
    sizes = np.diff(at)
    values = flat.to_numpy(zero_copy_only=False)
    rest = np.maximum(sizes - masked, 0)
    ended = np.zeros(len(sizes), dtype=bool)
    ended[rest > 0] = values[at[1:][rest > 0] - 1] == eos
    return cut_lists(ids, 0, masked), cut_lists(ids, masked, rest - ended)


def split_ocr_rows(rows: DataFrame, eos: int) -> DataFrame:
    """The inverse: prompt, and target without its end token."""
    n = F.size(F.filter("labels", lambda x: x == IGNORE))
    rest = F.slice("ids", n + 1, F.size("ids"))
    target = F.when(F.get(rest, F.size(rest) - 1) == eos, F.slice(rest, F.lit(1), F.size(rest) - 1)).otherwise(rest)
    return rows.withColumns({"prompt": F.slice("ids", F.lit(1), n), "target": target})
