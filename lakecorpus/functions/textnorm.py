"""Text normalizers as column expressions; where Unicode normal forms are needed, as Arrow UDFs.

The variants differ on purpose: keys and outputs depend on which one was used.
"""

from __future__ import annotations

import json
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Python's str.isspace() has it, inside a character class; the spelling suits Java and RE2 (fixed value).
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The same without the line feed.
INLINE_SPACE = r"\t\x0b-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: A class of all white space and unspaced characters beyond ASCII, and of others: few ranges, so one look is cheap and spares most texts the full classes (fixed value).
FOREIGN = r"\x{85}\x{a0}\x{1680}-\x{ffff}"
#: Invisible characters that only defeat comparison (fixed value).
ZERO_WIDTH = r"\x{200b}\x{200c}\x{200d}\x{feff}\x{ad}\x{2060}"
CONTROLS = r"\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}"
#: Texts that stand for a missing value (fixed value).
NULLISH = ("null", "none", "nan")


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def squash(text: Column) -> Column:
    """Runs of white space as one space, without any at the ends."""
    return F.btrim(F.regexp_replace(text, rf"[{SPACE}]+", " "))


def squash_breaks(text: Column) -> Column:
    """Only runs of space, tab and line ends as one space; other spaces carry meaning and stay."""
    return F.regexp_replace(text, r"[\n\r\t ]+", " ")


def fold_answer(text: Column) -> Column:
    """Lower case, squashed."""
    return squash(F.lower(text))


def fold_control(text: Column) -> Column:
    """Without variation selectors, vowel separator, joiners and byte order mark; the narrow no-break space as a space."""
    return F.translate(text, "\u202f\u180b\u180c\u180d\u180f\u180e\u200c\u200d\ufeff", " ")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def join_lines(parts: Column) -> Column:
    return F.array_join(parts, "\n")


def limit_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


#: All that tidy_web changes besides spaces and line feeds is of this class.
_UNTIDY = rf"[\x00-\x09\x0b-\x1f\x7f-\x{{a0}}\x{{ad}}{FOREIGN}]"


def tidy_web(text: Column) -> Column:
    """The web normalizer behind the compatibility form: invisible and control characters out, line ends unified, spaces squashed in each line."""
    t = F.coalesce(text, F.lit(""))
    # most texts have nothing of the kind, which one look tells
    plain = F.regexp_replace(t, f"[{ZERO_WIDTH}]", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\r\n?", "\n"), f"[{CONTROLS}]", "")
    plain = F.regexp_replace(plain, rf"[{INLINE_SPACE}]+", " ")
    t = F.when(t.contains("  ") | t.rlike(_UNTIDY), plain).otherwise(t)
    # what white space is left are line feeds and single spaces
    return F.btrim(limit_blank_lines(F.replace(F.replace(t, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))), F.lit(" \n"))


@F.pandas_udf(StringType())
def _nfkc(s):
    import pandas as pd

    return pd.Series([None if t is None else unicodedata.normalize("NFKC", t) for t in s])


def normalize_web(text: Column) -> Column:
    """Compatibility form, then tidy_web; null is empty."""
    return tidy_web(_nfkc(text))


def _per_value(function):
    """An Arrow-batched UDF from a function of one string."""

    @F.pandas_udf(StringType())
    def run(s):
        import pandas as pd

        return pd.Series([function(t) for t in s])

    return run


def _printable(text: str, instead: str) -> str:
    return "".join(c if c in "\n\t" or unicodedata.category(c)[0] != "C" else instead for c in text)


def plain_document(text: str | None, keep_newlines: bool = True) -> str:
    """Compatibility form, ideographic and no-break spaces as spaces, category C out, lines squashed."""
    t = unicodedata.normalize("NFKC", text or "").replace("\u3000", " ").replace("\xa0", " ")
    rows = [" ".join(x.split()) for x in _printable(t, "").splitlines()]
    if not keep_newlines:
        return " ".join(x for x in rows if x)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(rows)).strip()


def plain_line(text: str | None) -> str:
    """Canonical form on one line; category C as spaces; a nullish text is empty."""
    t = unicodedata.normalize("NFC", (text or "").replace("\ufeff", ""))
    t = _printable(t, " ").replace("\n", " ").strip()
    return "" if t.lower() in NULLISH else t


def plain_value(value) -> str:
    """Text of any JSON value: lists line by line, objects by their usual keys or as JSON; no blank lines."""
    if value is None:
        return ""
    if isinstance(value, list):
        return "\n".join(x for x in map(plain_value, value) if x)
    if isinstance(value, dict):
        usual = [plain_value(value[k]) for k in ("role", "content", "from", "value", "text") if value.get(k)]
        return "\n".join(x for x in usual if x) or json.dumps(value, ensure_ascii=False)
    t = unicodedata.normalize("NFC", str(value).replace("\ufeff", "")).replace("\r\n", "\n").replace("\r", "\n")
    rows = [" ".join(x.split()) for x in _printable(t, " ").split("\n")]
    out = "\n".join(x for x in rows if x)
    return "" if out.lower() in NULLISH else out


normalize_document = _per_value(plain_document)
normalize_key = _per_value(lambda t: plain_document(t, keep_newlines=False))
normalize_line = _per_value(plain_line)


@F.pandas_udf(StringType())
def normalize_json(s):
    import pandas as pd

    def one(t):
        try:
            return plain_value(json.loads(t)) if t is not None else ""
        except ValueError:
            return plain_value(t)

    return pd.Series([one(t) for t in s])


#: Patterns of the line normalizer (fixed values).
URL = r"(?i)https?://\S+|www\.\S+"
EMAIL = r"\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b"
LEADING_PAGE = r"(?i)^\s*(?:\|+\s*)?#?\s*page\s*[-_#:]?\s*\d+\s*#?\s*"
PAGE_TOKEN = r"(?i)(?:^|\s|\|)#?\s*page\s*[-_#:]?\s*\d+\s*#?(\s|$)"
ORNAMENTS = r"★☆*#=_\-—–·•|"


def normalize_running_line(line: Column) -> Column:
    """One line without controls, private-use characters, addresses and page marks; ornaments once."""
    t = F.regexp_replace(line, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{e000}-\x{f8ff}]", "")
    t = F.regexp_replace(F.regexp_replace(t, URL, " "), EMAIL, " ")
    t = F.regexp_replace(t, rf"[\t\r\f\x0b\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, LEADING_PAGE, ""), PAGE_TOKEN, " $1")
    t = F.regexp_replace(t, rf"([{ORNAMENTS}])\1{{2,}}", "$1")
    return strip(F.regexp_replace(t, " {2,}", " "))


def utf8_hex(text: Column) -> Column:
    """The bytes of a text as two-digit lower-case hex, one array element each."""
    return F.regexp_extract_all(F.lower(F.hex(text.cast("binary"))), F.lit(".."), F.lit(0))
