"""Text metrics as column expressions.

Ratios are of whole counts, so every engine gives the same value; none divides by zero.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .batches import parts
from .textnorm import FOREIGN, SPACE, lines, strip

#: Character classes of scripts (fixed values).
SCRIPTS = {
    "zh": r"\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}",
    "mongolian": r"\x{1800}-\x{18af}\x{11660}-\x{1167f}",
    "cyrillic": r"\x{0400}-\x{04ff}\x{0500}-\x{052f}\x{2de0}-\x{2dff}\x{a640}-\x{a69f}",
    "ja": r"\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{31f0}-\x{31ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}",
    "latin": r"A-Za-z\x{c0}-\x{24f}",
}
#: Scripts without spaces between words: each character is a token (fixed value).
UNSPACED = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{3040}-\x{309f}\x{30a0}-\x{30ff}"
SYMBOLS = "#…•·|►▶■□▪"
SENTENCE_ENDS = "。！？!?…"


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where the body uses it inside a lambda for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def count_of(text: Column, inside: str) -> Column:
    """Characters of a class, by what is left without them: no array of matches is built."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{inside}]+", ""))


def ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return bound(whole, lambda n: F.when(n > 0, part / n).otherwise(F.lit(empty)))


def ratio_of(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """``ratio`` of two counts that are there already."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


#: Bits of a character's class, and what is counted in a text: code points in all and without white space at the ends, tokens and runs of visible characters,
#: words (runs with a letter and without unspaced characters), lines that aren't blank, and those without repeats.
_BLANK, _UNSPACED, _LETTER, _SYMBOL = 1, 2, 4, 8
COUNTS = ("n_chars", "n_stripped", "n_visible", "n_tokens", "n_runs", "n_symbols", "n_words", "word_chars", "n_lines", "n_distinct_lines")


@functools.lru_cache(1)
def _classes() -> np.ndarray:
    """The class of each code point; str.isspace() is SPACE."""
    kinds = np.zeros(0x110000, dtype=np.uint8)
    for k in range(0x110000):
        c = chr(k)
        kinds[k] = _BLANK * c.isspace() | _LETTER * (unicodedata.category(c)[0] == "L")
    for first, last in ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x3040, 0x30FF)):
        kinds[first : last + 1] |= _UNSPACED
    kinds[[ord(c) for c in SYMBOLS]] |= _SYMBOL
    return kinds


def _counts(texts: list[str]) -> np.ndarray:
    """A row of COUNTS for each text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    at = np.r_[0, np.cumsum(sizes + 1)]  # a line feed behind each text ends its last run
    kinds = _classes()[np.frombuffer("".join([t + "\n" for t in texts]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    of = lambda flags: np.add.reduceat(flags, at[:-1], dtype=np.int64)
    opens = lambda flags: flags & ~np.r_[False, flags[:-1]]
    seen, alone = (kinds & _BLANK) == 0, (kinds & _UNSPACED) != 0
    runs = opens(seen)
    first = np.flatnonzero(runs)
    words, letters = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    if len(first):
        kind, long = np.bitwise_or.reduceat(kinds, first), np.add.reduceat(seen, first, dtype=np.int64)
        is_word = (kind & (_LETTER | _UNSPACED)) == _LETTER
        owner = np.searchsorted(at[1:], first[is_word], side="right")
        words = np.bincount(owner, minlength=len(texts))
        letters = np.bincount(owner, long[is_word], minlength=len(texts))
    full = [[y for x in t.split("\n") if (y := x.strip())] for t in texts]
    columns = [sizes, [len(t.strip()) for t in texts], of(seen), of(alone | opens(seen & ~alone)), of(runs), of((kinds & _SYMBOL) != 0), words, letters, [len(x) for x in full], [len(set(x)) for x in full]]
    return np.stack([np.asarray(c, dtype=np.int64) for c in columns], axis=1)


@F.arrow_udf(StructType([StructField(n, IntegerType()) for n in COUNTS]))
def text_counts(texts: pa.Array) -> pa.Array:
    """COUNTS of each text as a struct, made in numpy in one pass; all are null for null. No part of a lambda."""
    rows = [_counts([t or "" for t in texts.slice(a, b - a).to_pylist()]) for a, b in parts(texts)]
    table = np.concatenate(rows) if rows else np.zeros((0, len(COUNTS)), dtype=np.int64)
    none = texts.is_null().to_numpy(zero_copy_only=False)
    return pa.StructArray.from_arrays([pa.array(c, type=pa.int32(), mask=none) for c in table.T], names=list(COUNTS))


def visible(text: Column) -> Column:
    """Characters that aren't white space."""
    return text_counts(text)["n_visible"]


def script_class(script: str) -> str:
    if script not in SCRIPTS:
        raise ValueError(f"unknown script {script!r}")
    return SCRIPTS[script]


def script_ratio(text: Column, script: str) -> Column:
    """Share of a script among visible characters."""
    return ratio(count_of(text, script_class(script)), visible(text))


def script_ratio_no_digits(text: Column, script: str) -> Column:
    """Share of a script among visible characters that aren't digits."""
    return ratio(count_of(text, script_class(script)), F.length(F.regexp_replace(text, rf"[{SPACE}\p{{Nd}}]+", "")))


def script_letter_ratio(text: Column, script: str) -> Column:
    """Share of a script's letters among letters."""
    return ratio(count_of(text, rf"[{script_class(script)}]&&\p{{L}}"), count_of(text, r"\p{L}"))


def tokens(text: Column) -> Column:
    """Runs of visible characters; each character of an unspaced script by itself."""
    every = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # visible ASCII comes first in the class, so most characters pass one test
    return F.when(text.rlike(f"[{FOREIGN}]"), every(f"[!-~[^{SPACE}{UNSPACED}]]+|[{UNSPACED}]")).otherwise(every(r"[^\t-\r\x1c-\x20]+"))


def token_count(text: Column) -> Column:
    return text_counts(text)["n_tokens"]


def dedup_terms(text: Column) -> Column:
    """Mongolian words if there are any, else tokens."""
    words = F.regexp_extract_all(text, F.lit(f"[{SCRIPTS['mongolian']}]+"), F.lit(0))
    return F.when(F.size(words) > 0, words).otherwise(tokens(text))


def full_lines(text: Column) -> Column:
    """Stripped lines that aren't empty."""
    return F.filter(F.transform(lines(text), strip), lambda x: x != "")


def repeated_line_fraction(text: Column, least_lines: int = 1) -> Column:
    """Share of lines equal to an earlier one; 0 for fewer than ``least_lines``."""
    n = text_counts(text)
    return F.when(n["n_lines"] >= max(1, least_lines), (n["n_lines"] - n["n_distinct_lines"]) / n["n_lines"]).when(n["n_lines"].isNotNull(), 0.0)


def symbol_to_word_ratio(text: Column) -> Column:
    """Symbols for each token; 1 if there are no tokens."""
    n = text_counts(text)
    return ratio_of(n["n_symbols"], n["n_tokens"], 1.0)


def symbol_to_char_ratio(text: Column) -> Column:
    """Symbols for each visible character; 1 if there are none."""
    n = text_counts(text)
    return ratio_of(n["n_symbols"], n["n_visible"], 1.0)


def mean_word_length(text: Column) -> Column:
    """Mean length of words with a letter and without characters of unspaced scripts; null for fewer than five."""
    n = text_counts(text)
    return F.when(n["n_words"] >= 5, n["word_chars"] / n["n_words"])


def digit_ratio(text: Column) -> Column:
    return ratio(count_of(text, r"\p{Nd}"), visible(text))


def garble_ratio(text: Column) -> Column:
    """Replacement and private-use characters among visible ones."""
    return ratio(count_of(text, r"\x{fffd}\x{e000}-\x{f8ff}"), visible(text))


def replacement_ratio(text: Column) -> Column:
    return ratio(count_of(text, r"\x{fffd}"), F.length(text))


def sentence_end_ratio(text: Column, script: str = "zh") -> Column:
    """Sentence ends for each character of a script; 0 if there are none of it."""
    return ratio(count_of(text, SENTENCE_ENDS), count_of(text, script_class(script)))


def compact(text: Column) -> Column:
    """Without white space."""
    most = F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))
    return F.when(most.rlike(rf"[\t-\r\x1c-\x1f{FOREIGN}]"), F.regexp_replace(most, f"[{SPACE}]+", "")).otherwise(most)


def _ranks(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Equal values as equal whole numbers from 0, and how many there are."""
    kinds, at = np.unique(values, return_inverse=True)
    return at.astype(np.int64), len(kinds)


def _gram_codes(chars: np.ndarray, longest: int):
    """(n, code of each n-gram, kinds) for n from 1 to ``longest``: an n-gram is the one before it and a character more."""
    first, kinds = _ranks(chars)
    letters, at = kinds, first
    for n in range(1, longest + 1):
        if n > 1:
            at, kinds = _ranks(at[:-1] * letters + first[n - 1 :])
        yield n, at, kinds


def ngram_shares(text: Column, top: tuple[int, ...] = (2,), repeated: tuple[int, ...] = (3, 4)) -> Column:
    """A struct of the shares of character n-grams, each text taken apart once in numpy.

    ``top_n``: characters that the most frequent n-gram covers, overlaps counted twice, for each character. ``repeated_n``: n-grams equal
    to an earlier one, for each n-gram. Both are 0 for texts of n characters or fewer, and for null.
    """
    names = [f"top_{n}" for n in top] + [f"repeated_{n}" for n in repeated]

    def one(t: str | None) -> tuple[float, ...]:
        share = dict.fromkeys(names, 0.0)
        chars = np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if len(chars):
            for n, at, kinds in _gram_codes(chars, min(len(chars) - 1, max((*top, *repeated)))):
                if n in top:
                    share[f"top_{n}"] = int(np.bincount(at, minlength=1).max()) * n / len(chars)
                if n in repeated:
                    share[f"repeated_{n}"] = (len(at) - kinds) / len(at)
        return tuple(share.values())

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def shares(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in s], columns=names)

    return shares(text)


def token_proxy(text: Column) -> Column:
    """Rough number of tokens: words, or a quarter of the characters, at least 1."""
    n = text_counts(text)
    return F.greatest(n["n_runs"], F.floor(n["n_chars"] / 4), F.lit(1)).cast("long")


def graphemes(text: str) -> list[str]:
    """Clusters of a base with the variation selectors and marks behind it; vowel separator and narrow space stand alone."""
    out: list[str] = []
    alone = "\u180e\u202f"
    for c in text:
        joins = c in "\u180b\u180c\u180d\u180f" or unicodedata.category(c) in ("Mn", "Mc", "Me")
        if c not in alone and joins and out and out[-1] not in alone:
            out[-1] += c
        else:
            out.append(c)
    return out
