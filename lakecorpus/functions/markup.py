"""Text of Markdown and HTML."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

from .textnorm import SPACE, limit_blank_lines, plain_document, strip

#: Elements that are no text of a page (fixed values).
NOISE = ("script", "style", "noscript", "header", "footer", "nav")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def markdown_to_text(text: Column) -> Column:
    """Without fences, images, marks of code, links, headings, bullets and quotes."""
    t = F.regexp_replace(text, r"(?s)```.*?```", " ")
    t = F.regexp_replace(t, r"`([^`]+)`", "$1")
    t = F.regexp_replace(t, r"!\[[^\]]*\]\([^)]+\)", " ")
    t = F.regexp_replace(t, r"\[([^\]]+)\]\([^)]+\)", "$1")
    for mark in (r"#{1,6}\s*", r"[-*+]\s+", r">\s?"):
        t = F.regexp_replace(t, rf"(?m)^\s{{0,3}}{mark}", "")
    t = F.regexp_replace(t, r"[ \t\r\f\x0b]+", " ")
    return strip(limit_blank_lines(F.array_join(F.transform(F.split(t, "\n", -1), strip), "\n")))


class _Texts(HTMLParser):
    """Text nodes outside noise, and those inside elements that a selector (tag, #id or .class) matches."""

    def __init__(self, selectors: tuple[str, ...] = ()):
        super().__init__(convert_charrefs=True)
        self.selectors = selectors
        self.open: list[tuple[str, int | None]] = []
        self.noise = 0
        self.found: list[tuple[int, list[str]]] = []
        self.all: list[str] = []
        self.title: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        a = dict(attrs)
        names = {tag, f"#{a.get('id')}", *(f".{c}" for c in (a.get("class") or "").split())}
        hit = next((k for k, s in enumerate(self.selectors) if s in names), None)
        index = None
        if hit is not None and not self.noise:
            index = len(self.found)
            self.found.append((hit, []))
        self.open.append((tag, index))
        self.noise += tag in NOISE

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.noise -= sum(t in NOISE for t, _ in self.open[k:])
                del self.open[k:]
                return

    def handle_data(self, data):
        text = data.strip()
        if not text:
            return
        if any(t == "title" for t, _ in self.open):
            self.title.append(text)
            return
        if self.noise:
            return
        self.all.append(text)
        for _, index in self.open:
            if index is not None:
                self.found[index][1].append(text)


def html_parts(page: str | None, selectors: tuple[str, ...] = ()) -> tuple[str, str]:
    """(text, title). The text is that of the longest element of the first selector that matches, else of the page.

    Text that follows a removed element stays.
    """
    p = _Texts(selectors)
    p.feed(re.sub(r"^\s*<\?xml[^>]*\?>", "", page or ""))
    p.close()
    texts = p.all
    if p.found:
        best = min(k for k, _ in p.found)
        texts = max((t for k, t in p.found if k == best), key=lambda t: sum(map(len, t)))
    return plain_document("\n".join(texts)), plain_document(" ".join(p.title), keep_newlines=False)


def html_text(selectors: tuple[str, ...] = ()):
    """A UDF from a page to (text, title)."""

    @F.pandas_udf("text string, title string")
    def run(pages):
        import pandas as pd

        return pd.DataFrame([html_parts(p, selectors) for p in pages], columns=["text", "title"])

    return run


def html_title(page: Column) -> Column:
    """The content of the first title element, squashed; '' without one."""
    title = F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return strip(F.regexp_replace(title, rf"[{SPACE}]+", " "))


def unescape_html(text: str | None) -> str:
    """Character references decoded, no-break spaces as spaces."""
    return unescape(text or "").replace("\xa0", " ")


def strip_ruby_markup(text: Column) -> Column:
    """A plain-text edition without head matter, colophon, ruby, bars and annotations."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"(?s)^.*?-{20,}\n.*?-{20,}\n", "")
    t = F.regexp_replace(t, r"(?s)\n底本[:：].*$", "")
    t = F.regexp_replace(t, r"《[^》]*》", "")
    t = F.regexp_replace(t, r"[|｜]", "")
    return strip(F.regexp_replace(t, r"［＃[^］]*］", ""))


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9._-]+", "-"), r"^-+|-+$", "")
