"""Main text of web pages by a tree-structured graphical model over the DOM.

Block elements and runs of text are nodes. A node is boilerplate, content, or (an element) a mixture. Potentials
connect each node with its parent, and observations of a node (tag, words of class and id, length, links,
punctuation) weigh its states. Sum-product messages pass from the leaves up and from the root down; the runs of
text whose marginal favours content are the main text. All tables are counted on labelled pages.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

BOILERPLATE, CONTENT, MIXED = range(3)
#: Marks labelled content in training pages: a private-use character in front of each run.
MARK = "\ue000"

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/><]*)")
#: What comes next inside a tag: a quoted value, the end, or another tag where the end is missing.
_IN_TAG = re.compile(r"=\s*[\"']|>|<(?=[a-zA-Z/!?])")
_AFTER_VALUE = frozenset(" \t\n\r\f/>")
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Kinds of HTML elements (fixed values).
_BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_SKIPPED = frozenset("script style noscript template iframe object svg canvas head title select textarea button audio video".split())
_RAW = frozenset("script style textarea title noscript iframe".split())
_BREAKS = frozenset("br hr".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tr", "td", "th", "tbody", "thead"), "tbody": ("tr", "td", "th", "tbody", "thead"), "tfoot": ("tr", "td", "th", "tbody", "thead")}
_SCOPES = tuple("ul ol dl table body html div section article".split())
_LISTS = ("ul", "ol", "dl", "table")
#: What ends a head that is never closed.
_ENDS_HEAD = _BLOCKS - {"html"}


@dataclass
class Node:
    tag: str  # "#text" for a run
    parent: int
    attributes: str = ""
    text: str = ""
    chars: int = 0
    linked: int = 0
    children: list[int] = field(default_factory=list)


class _Finder:
    """Next places of single strings at or after a place that only moves forward, each part of the page searched once."""

    def __init__(self, page: str):
        self.page, self.next = page, {}

    def __call__(self, what: str, at: int) -> int:
        """The length of the page if there is none."""
        k = self.next.get(what, -1)
        if k < at:
            k = self.page.find(what, at)
            self.next[what] = k = len(self.page) if k < 0 else k
        return k


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of each tag, in time in proportion to the page; comments and declarations have no name.

    A tag is never text: where its end is missing it goes to the next tag or the end of the page, and a quote that
    doesn't close at a plausible place doesn't hide the end of the tag. Who sends a place to the generator goes on there.
    """
    find, at, n = _Finder(page), 0, len(page)
    while (at := find("<", at)) < n:
        start = at
        m = _NAME.match(page, at)
        if m is None:
            if page.startswith("<!--", at):
                end = min(n, find("-->", at + 4) + 3)
            elif page.startswith(("<!", "<?", "</"), at):
                end = min(n, find(">", at) + 1)
            else:
                at += 1
                continue
            to = yield start, end, "", False, ""
            at = to or end
            continue
        i = end = m.end()
        while True:
            stop = _IN_TAG.search(page, i)
            if stop is None:
                end = i = n
                break
            if stop[0] == ">":
                end, i = stop.end(), stop.start()
                break
            if stop[0] == "<":
                end = i = stop.start()
                break
            close = find(stop[0][-1], stop.end())
            if close < n and page[close - 1] != "=" and (close + 1 == n or page[close + 1] in _AFTER_VALUE):
                i = close + 1
            else:
                i = min(find(">", stop.end()), find("<", stop.end()))
                end = min(n, i + 1) if page.startswith(">", i) else i
                break
        to = yield start, end, m[2].lower(), bool(m[1]), page[m.end() : i]
        at = to or end


_RAW_END = {t: re.compile(f"</{t}\\b[^>]*>?", re.I) for t in _RAW}


def parse(page: str) -> list[Node]:
    """Nodes of a page, parents before children, in page order. Never fails, however broken the page, and takes time in proportion to it."""
    nodes = [Node("#root", -1)]
    stack = [0]
    places: dict[str, list[int]] = {}  # where in the stack each tag is open
    run: list[str] = []
    state = {"links": 0, "linked": 0}

    def end_run() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            nodes[stack[-1]].children.append(len(nodes))
            nodes.append(Node("#text", stack[-1], text=text, chars=len(text), linked=min(len(text), state["linked"])))
        run.clear()
        state["linked"] = 0

    def last(names: tuple[str, ...]) -> int:
        return max((places[t][-1] for t in names if places.get(t)), default=0)

    def close(names: tuple[str, ...], scope: tuple[str, ...] = ()) -> None:
        """Closes the last open one of the names, if it isn't outside the last of the scope."""
        k = last(names)
        if k and k > last(scope):
            for x in stack[k:]:
                places[nodes[x].tag].pop()
            del stack[k:]

    def enter(tag: str, attributes: str) -> None:
        places.setdefault(tag, []).append(len(stack))
        nodes[stack[-1]].children.append(len(nodes))
        nodes.append(Node(tag, stack[-1], attributes))
        stack.append(len(nodes) - 1)

    at, skip, goto = 0, None, None
    found = tags(page)
    while True:
        try:
            start, end, tag, closing, attributes = found.send(goto)
        except StopIteration:
            break
        goto = None
        if start > at and skip is None:
            text = page[at:start]
            run.append(text)
            if state["links"]:
                state["linked"] += len(text.strip())
        at = end
        if not tag:
            continue
        if skip is not None:
            if closing and tag == skip[0]:
                skip = (skip[0], skip[1] - 1) if skip[1] > 1 else None
                continue
            if not closing and tag == skip[0]:
                skip = (skip[0], skip[1] + 1)
                continue
            # what is never closed ends with the block around it, a head with the first block of a body
            if not (closing and tag in _BLOCKS and places.get(tag)) and not (skip[0] == "head" and not closing and tag in _ENDS_HEAD):
                if tag in _RAW and not closing:
                    stop = _RAW_END[tag].search(page, at)
                    at = goto = stop.end() if stop else len(page)
                continue
            skip = None
        if not closing and tag in _SKIPPED:
            if attributes.endswith("/") and tag not in ("script", "style"):
                continue
            if tag in _RAW:
                stop = _RAW_END[tag].search(page, at)
                at = goto = stop.end() if stop else len(page)
            else:
                skip = (tag, 1)
            continue
        if tag in _BREAKS:
            end_run()
        elif tag == "a":
            state["links"] = 0 if closing else 1
        elif tag in _BLOCKS:
            end_run()
            state["links"] = 0
            if closing:
                close((tag,))
            elif tag in ("html", "body"):
                if not places.get(tag):
                    enter(tag, attributes)
            else:
                close(("p",), (*_SCOPES, "li", "td", "th", "blockquote"))
                if tag in _CLOSES:
                    close(_CLOSES[tag], _LISTS)
                enter(tag, attributes)
    if skip is None and at < len(page):
        run.append(page[at:])
    end_run()
    for n in reversed(nodes):
        if n.parent >= 0:
            nodes[n.parent].chars += n.chars
            nodes[n.parent].linked += n.linked
    return nodes


def observations(node: Node) -> list[tuple[str, str]]:
    """(group, value) of what is seen of a node."""
    length = min(9, node.chars.bit_length())
    links = 0 if not node.linked else 1 + int(3 * node.linked / max(1, node.chars))
    if node.tag == "#text":
        last = node.text[-1]
        kind = "stop" if last in ".!?…:;\"”»" else "letter" if last.isalpha() else "other"
        return [("run-length", str(length)), ("run-links", str(links)), ("run-end", kind), ("run-signs", str(int("©" in node.text)))]
    out = [("tag", node.tag + " of links" * (links >= 2)), ("links", str(links)), ("length", str(length))]
    if node.attributes:
        names = [a or b or c for a, b, c in _ATTRIBUTE.findall(node.attributes)]
        out += [("name", w.lower()) for w in {*_PARTS.findall(" ".join(names))}]
    return out


@dataclass
class Model:
    """Root prior, parent-child potentials and log weights of observations by state."""

    root: list[float]
    child: list[list[float]]
    weights: dict[tuple[str, str], list[float]]

    def marginals(self, nodes: list[Node]) -> list[list[float]]:
        """The distribution of each node's state given all observations of the page."""
        n = len(nodes)
        own = []
        for node in nodes:
            w = [0.0, 0.0, -math.inf if node.tag == "#text" else 0.0]
            for o in observations(node):
                if o in self.weights:
                    w = [a + b for a, b in zip(w, self.weights[o], strict=True)]
            top = max(w)
            own.append([math.exp(x - top) for x in w])
        up = [list(x) for x in own]
        message = [[1.0] * 3] * n
        for k in range(n - 1, 0, -1):  # children come after their parent
            u = up[k]
            s = sum(u)
            u = up[k] = [x / s for x in u]
            m = [sum(t * x for t, x in zip(row, u, strict=True)) for row in self.child]
            message[k] = m
            p = up[nodes[k].parent]
            up[nodes[k].parent] = q = [a * b for a, b in zip(p, m, strict=True)]
            if max(q) < 1e-200:
                top = max(q) or 1.0
                up[nodes[k].parent] = [x / top for x in q]
        belief = [[]] * n
        b = [a * x for a, x in zip(up[0], self.root, strict=True)]
        s = sum(b) or 1.0
        belief[0] = [x / s for x in b]
        for k in range(1, n):
            p = belief[nodes[k].parent]
            rest = [a / m if m > 1e-300 else 0.0 for a, m in zip(p, message[k], strict=True)]
            down = [sum(rest[x] * self.child[x][y] for x in range(3)) for y in range(3)]
            b = [d * x for d, x in zip(down, up[k], strict=True)]
            s = sum(b) or 1.0
            belief[k] = [x / s for x in b]
        return belief

    def extract(self, page: str | None) -> str:
        """The main text: the runs more likely content than not, in page order, joined by one space."""
        if not page:
            return ""
        nodes = parse(page)
        if len(nodes) == 1:
            return ""
        belief = self.marginals(nodes)
        return " ".join(n.text for n, b in zip(nodes, belief, strict=True) if n.tag == "#text" and b[CONTENT] > 0.5)


def train(pages: list[str], smoothing: float = 0.05, run_weight: float = 0.3, name_weight: float = 1.5) -> Model:
    """Counts a model on labelled pages: content runs begin with MARK, all others are boilerplate.

    Runs of one block say much the same, so their observations count with ``run_weight``; a name that
    an author gave tells more than a shape, ``name_weight``.
    """
    pairs, seen, root = Counter(), Counter(), Counter()
    for page in pages:
        nodes = parse(page)
        state = [None] * len(nodes)
        for k in range(len(nodes) - 1, -1, -1):
            node = nodes[k]
            if node.tag == "#text":
                state[k] = CONTENT if MARK in node.text else BOILERPLATE
                node.text = node.text.replace(MARK, "") or "x"
            else:
                below = {state[c] for c in node.children}
                state[k] = below.pop() if len(below) == 1 else MIXED if below else BOILERPLATE
        root[state[0]] += 1
        for k, node in enumerate(nodes):
            if k:
                pairs[state[node.parent], state[k]] += 1
            for o in observations(node):
                seen[o, state[k]] += 1
    groups: dict[str, set[str]] = {}
    for (group, value), _ in seen:
        groups.setdefault(group, set()).add(value)
    totals = Counter()
    for (o, s), c in seen.items():
        totals[o[0], s] += c
    weights = {}
    for group, values in groups.items():
        for v in values:
            power = run_weight if group.startswith("run") else name_weight if group == "name" else 1.0
            weights[group, v] = [power * math.log((seen[(group, v), s] + smoothing) / (totals[group, s] + smoothing * len(values))) for s in range(3)]
    child = []
    for a in range(3):
        row = [pairs[a, b] + 0.01 for b in range(3)]
        child.append([x / sum(row) for x in row])
    total = sum(root.values()) + 0.3
    return Model([(root[s] + 0.1) / total for s in range(3)], child, weights)


#: Names that pages give to what isn't the article, and to the article (fixed values).
_NAMES = {
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs topbar toolbar skip",
    "header": "header masthead logo branding site-header",
    "footer": "footer site-footer copyright legal colophon bottom",
    "sidebar": "sidebar widget side rail aside secondary",
    "notice": "notice cookie cookies consent alert banner message popup modal paywall newsletter subscribe signup",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adsense",
    "form": "form search login contact",
    "comments": "comments comment replies reply discussion disqus respond reader",
    "more": "related recommended share social tags pagination pager trending popular meta author-box",
}
_ARTICLE = "content article post entry story main body text article-body post-content entry-content main-content"


def labelled_pages(n: int = 1200, seed: int = 7) -> list[str]:
    """Labelled training pages of many layouts, some broken as pages on the web are."""
    rng = random.Random(seed)

    def word() -> str:
        return "".join(rng.choice("aeioutnrsldmchpgbv") for _ in range(rng.randint(1, 9)))

    def sentence(a: int, b: int) -> str:
        w = " ".join(word() for _ in range(rng.randint(a, b)))
        return w[:1].upper() + w[1:] + rng.choice("....!?")

    def prose(a: int = 1, b: int = 6) -> str:
        return " ".join(sentence(3, 18) for _ in range(rng.randint(a, b)))

    def link(mark: str = "") -> str:
        return f'<a href="/{word()}">{mark}{" ".join(word() for _ in range(rng.randint(1, 3)))}</a>'

    def links() -> str:
        return "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 9))) + "</ul>"

    def named(kind: str, inside: str, tags: tuple[str, ...] = ("div",)) -> str:
        name = rng.choice(_NAMES[kind].split())
        return f'<{(t := rng.choice(tags))} {rng.choice(("class", "class", "id"))}="{name}">{inside}</{t}>'

    def boilerplate(kind: str) -> str:
        plain = rng.random() < 0.4
        if kind == "menu":
            return f"<nav>{links()}</nav>" if plain else named(kind, rng.choice((links(), " | ".join(link() for _ in range(4)))))
        if kind == "header":
            inside = rng.choice((f"<h1>{link()}</h1><p>{sentence(2, 6)}</p>", f"<p>{sentence(2, 9)}</p>", f"<div>{word()}</div>{links()}"))
            return f"<header>{inside}</header>" if plain else named(kind, inside)
        if kind == "footer":
            inside = rng.choice((f"&copy; {word()} &middot; {sentence(3, 15)}", f"<p>&copy; 2020 {word()}. {sentence(3, 9)}</p>{links()}", f"<p>{prose(1, 2)}</p>", links()))
            return f"<footer>{inside}</footer>" if plain else named(kind, inside)
        if kind == "sidebar":
            inside = f"<h3>{sentence(1, 3)}</h3>" + rng.choice((links(), f"<p>{prose(1, 3)}</p>"))
            return f"<aside>{inside}</aside>" if plain else named(kind, inside, ("div", "section", "aside"))
        if kind == "form":
            inside = f"<label>{sentence(1, 4)}</label><input name=q><p>{sentence(3, 12)}</p><button>{word()}</button>"
            return f'<form action="/{word()}">{inside}</form>' if plain else named(kind, f"<form>{inside}</form>")
        if kind == "comments":
            inside = f"<h3>{sentence(1, 3)}</h3>" + "".join(rng.choice((f"<p>{prose(1, 4)}</p>", f'<div class="comment"><b>{word()}</b><p>{prose(1, 4)}</p></div>', f"<ol><li>{prose(1, 2)}</li></ol>")) for _ in range(rng.randint(1, 4)))
            return named(kind, inside, ("div", "section", "ul" if rng.random() < 0.1 else "section"))
        if kind == "more":
            return named(kind, rng.choice((links(), f"<h4>{sentence(1, 4)}</h4>{links()}", f"<p>{link()} {link()}</p>")), ("div", "section"))
        return named(kind, rng.choice((prose(1, 3), f"<p>{prose(1, 3)}</p>", f"<p>{sentence(3, 12)}</p>{link()}")), ("div", "div", "section", "aside"))

    def article() -> str:
        bits = [f"<h1>{MARK}{' '.join(word() for _ in range(rng.randint(2, 12)))}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 14)):
            kind = rng.random()
            closing = "</p>" if rng.random() < 0.85 else ""
            if kind < 0.7:
                text = prose(1, 9)
                if rng.random() < 0.2:
                    text = f"<b>{MARK}{text}{rng.choice(('</b>', '<br>'))}"
                elif rng.random() < 0.2:
                    text = f"{MARK}{text} {link()} {prose(1, 2)}"
                else:
                    text = f"{MARK}{text}"
                bits.append(f"<p>{text}{closing}")
            elif kind < 0.78:
                bits.append(f"<h2>{MARK}{sentence(1, 6)}</h2>")
            elif kind < 0.85:
                bits.append("<ul>" + "".join(f"<li>{MARK}{sentence(2, 14)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.89:
                bits.append(f"<blockquote><p>{MARK}{prose(1, 3)}</p></blockquote>")
            elif kind < 0.92:
                bits.append("<table>" + "".join(f"<tr><td>{MARK}{word()}</td><td>{MARK}{word()}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.94:
                bits.append(f"<pre>{MARK}{prose(1, 2)}</pre>")
            elif kind < 0.97:
                bits.append(f"<p>{MARK}{word()}{closing}")
            elif rng.random() < 0.6:
                bits.append(boilerplate(rng.choice(("ad", "more", "notice", "sidebar", "form", "comments"))))
        inside = "".join(bits)
        kind = rng.random()
        if kind < 0.5:
            return f"<article>{inside}</article>"
        if kind < 0.6:
            return f"<main>{inside}</main>"
        if kind < 0.85:
            return f'<{(t := rng.choice(("div", "section")))} {rng.choice(("class", "id"))}="{rng.choice(_ARTICLE.split())}">{inside}</{t}>'
        return f"<div>{inside}</div>"

    pages = []
    for _ in range(n):
        top = [boilerplate(k) for k in ("header", "menu", "notice", "ad", "form", "sidebar") if rng.random() < 0.4]
        low = [boilerplate(k) for k in ("more", "comments", "ad", "sidebar", "form", "notice", "footer") if rng.random() < 0.4]
        if rng.random() < 0.9:
            low.append(boilerplate("footer"))
        inside = "".join([*top, article() if rng.random() < 0.97 else "", *low])
        if rng.random() < 0.4:
            inside = f'<div {rng.choice(("class", "id"))}="{rng.choice(("page", "wrapper", "container", "site"))}">{inside}</div>'
        end = "</body></html>" if rng.random() < 0.9 else ""
        pages.append(f"<!DOCTYPE html><html><head><title>{sentence(2, 9)}</title><style>p{{}}</style></head><body>{inside}{end}")
    return pages


def extract_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``pages`` columns page_id and url with ``text``, the main text of the whole html.

    The model is a few thousand numbers; without one it is trained on labelled_pages(). Null and empty html give an empty
    text. Null ids and urls and repeated rows pass through; other columns are left out. An empty table gives an empty result.
    """
    model = model or train(labelled_pages())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                text = [model.extract(p) for p in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, type=pa.string())], names=["page_id", "url", "text"])

    schema = pages.select("page_id", "url").schema.add("text", "string")
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
