"""Main text of web pages by gradient-boosted trees over DOM nodes (op 1).

Each block element of a page is a node with features of its own and of its
subtree: text and link density, counts of paragraphs and of words, attribute
tokens, depth, place among its siblings and what those look like. The trees
give every node the chance of holding main text. Decoding is hierarchical: a
node can only be kept within a kept parent, and dropping a node drops its
subtree; the best consistent choice is found bottom-up, as
``drop(n) = sum over the subtree of log(1 - p)`` and
``keep(n) = log p(n) + sum over children of max(keep, drop)``.

The text of kept nodes is cut into blocks at block elements; white space in a
block becomes one space, blocks are joined by a line feed. Scripts, styles,
templates and the head never are text.

The classifier is trained on ``TRAIN_PAGES`` labelled layouts
(:mod:`html_layouts`); the pages table has no labels. Pages are read once,
row by row, without a shuffle.

Defined cases: null or empty html gives the empty text; text outside any
element belongs to the page's root; unclosed and stray tags are repaired as
browsers do for the common cases (open paragraphs and list items end at the
next block); equal pages give equal texts; an empty table gives an empty
table; only page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt, html_layouts
from .common import ship

ship(__name__)

TRAIN_PAGES = 1200

#: Fixed values of HTML: elements without content, raw text, and blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math textarea select object canvas title".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: An open element of these ends where one of the second kind begins.
ENDS = {
    "p": BLOCK - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"},
}
TAGS = ["p", "div", "article", "main", "section", "nav", "header", "footer", "aside", "form", "ul", "li", "table", "heading", "body"]
#: Attribute tokens that speak for either side (also matched inside longer names).
HINTS = [
    re.compile(r"article|content|entry|post|story|main|text|body"),
    re.compile(r"nav|menu|breadcrumb|tabs|pagination|toc"),
    re.compile(r"header|masthead|banner|logo|(?<![a-z])top"),
    re.compile(r"footer|copyright|legal|bottom|imprint"),
    re.compile(r"side|aside|widget|related|rail|popular|recommend|tags|trending"),
    re.compile(r"cookie|notice|consent|alert|modal|popup|gdpr|newsletter|overlay"),
    re.compile(r"(?<![a-z])ads?(?![a-z])|advert|sponsor|promo"),
    re.compile(r"form|search|login|subscribe|signup"),
    re.compile(r"comment|repl(y|ies)|discussion|respon|disqus"),
    re.compile(r"share|social|sharing|button|tools"),
    re.compile(r"hidden|display:\s*none"),
]
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"(?:class|id|role|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|(\bhidden\b)", re.I)
_LABEL = re.compile(r'data-y="([01])"')
_WHITE = re.compile(r"\s+")
#: What an end tag may not close across.
_SCOPE = frozenset("table td th html body".split())


class Node:
    __slots__ = ("tag", "attrs", "up", "kids", "text", "link", "blocks", "label", "n")

    def __init__(self, tag: str, attrs: str, up: Node | None, label: int):
        self.tag, self.attrs, self.up, self.label = tag, attrs, up, label
        self.kids: list[Node] = []
        self.text = 0  # own characters, outside links and inside
        self.link = 0


def parse(page: str, labels: bool = False) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block nodes in page order (a parent before its children) and the text
    blocks as (node, text)."""
    root = Node("root", "", None, 1)
    nodes, stack, blocks, run = [root], [root], [], []
    root.n = 0
    inline: list[str] = []  # open inline elements of the innermost block, links among them
    in_link, at, size = 0, 0, len(page)

    def flush() -> None:
        if run:
            text = _WHITE.sub(" ", entities.unescape("".join(run))).strip()
            run.clear()
            if text:
                blocks.append((stack[-1].n, text))

    def add(raw: str) -> None:
        run.append(raw)
        n = len(raw) if not raw.isspace() else 0
        if in_link:
            stack[-1].link += n
        else:
            stack[-1].text += n

    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        tag, attrs = name.lower(), m[3] or ""
        if m[1]:
            if tag == "a":
                in_link = 0
            elif tag in BLOCK:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag:
                        flush()
                        del stack[depth:]
                        in_link = 0
                        break
                    if stack[depth].tag in _SCOPE and tag not in _SCOPE:
                        break
            continue
        if tag in RAW or tag == "head":
            if attrs.endswith("/"):
                continue
            if tag == "head":  # up to its end tag or the body
                end = re.compile(r"</head\s*>|(?=<body[\s>])", re.I).search(page, at)
            else:
                end = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            if tag in ("textarea", "select", "title", "object"):
                add(" ")
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag == "a":
            in_link = 1
            continue
        if tag not in BLOCK:
            continue
        if tag == "hr":
            flush()
            continue
        if tag in ("html", "body") and any(x.tag == tag for x in stack):
            continue
        flush()
        while len(stack) > 1 and tag in ENDS.get(stack[-1].tag, ()):
            stack.pop()
        in_link = 0
        named = " ".join(next((x for x in a if x), "") for a in _ATTR.findall(attrs)).lower() if attrs else ""
        label = stack[-1].label
        if labels and (y := _LABEL.search(attrs)):
            label = int(y[1])
        node = Node(tag, named, stack[-1], label)
        node.n = len(nodes)
        nodes.append(node)
        stack[-1].kids.append(node)
        stack.append(node)
    flush()
    return nodes, blocks


_HEAD = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
_KIND = {t: i for i, t in enumerate(TAGS)}


def features(pages: list[list[Node]]) -> np.ndarray:
    """One row per node of all pages together. Sums over subtrees go up, and
    what ancestors say about themselves goes down, one depth at a time."""
    n, k = sum(map(len, pages)), len(TAGS)
    parent, depth, place, sibs, root = (np.zeros(n, np.int64) for _ in range(5))
    own, kinds, named = [], [], []
    said: dict[str, int] = {"": 0}
    base = 0
    for nodes in pages:
        root[base:base + len(nodes)] = base
        for x in nodes:
            i, tag = base + x.n, x.tag
            own.append((x.text, x.link, tag == "p", tag in _HEAD))
            kinds.append(_KIND.get("heading" if tag in _HEAD else "ul" if tag in ("ol", "menu", "dl") else tag, k))
            named.append(said.setdefault(x.attrs, len(said)))
            many = len(x.kids)
            for at, y in enumerate(x.kids):
                j = base + y.n
                parent[j], depth[j], place[j], sibs[j] = i, depth[i] + 1, at, many
        base += len(nodes)
    own = np.array(own, np.float64).reshape(n, 4)
    parent[root == np.arange(n)] = root[root == np.arange(n)]
    sibs = np.maximum(sibs, 1)
    kind = np.eye(k + 1)[kinds][:, :k]
    hints = np.array([[bool(h.search(a)) for h in HINTS] for a in said], np.float64)[named]
    levels = [np.flatnonzero(depth == d) for d in range(1, int(depth.max(initial=0)) + 1)]
    total, count = own.copy(), np.ones(n)
    for at in reversed(levels):
        np.add.at(total, parent[at], total[at])
        np.add.at(count, parent[at], count[at])
    above_kind, above_hints = kind.copy(), hints.copy()
    for at in levels:
        above_kind[at] = np.maximum(above_kind[parent[at]], kind[at])
        above_hints[at] = np.maximum(above_hints[parent[at]], hints[at])
    chars = total[:, 0] + total[:, 1]
    around = chars[parent] - chars
    return np.column_stack([
        np.log1p(chars), np.log1p(own[:, 0] + own[:, 1]), total[:, 1] / np.maximum(1, chars), chars / np.maximum(1, chars[root]),
        np.log1p(count), chars / count, total[:, 2], total[:, 3], total[:, 2] / count, depth, place, place / sibs, sibs - place, sibs,
        np.log1p(around / np.maximum(1, sibs - 1)), total[parent, 1] / np.maximum(1, chars[parent]), chars / np.maximum(1, chars[parent]),
        np.log1p(chars[parent]), total[parent, 2], kind, kind[parent], above_kind, hints, above_hints,
    ])


def decode(nodes: list[Node], raw: np.ndarray) -> list[bool]:
    """Kept nodes: the likeliest choice in which no node is kept without its
    parent. ``raw``: log-odds."""
    keep, drop = (-np.logaddexp(0, -raw)).tolist(), (-np.logaddexp(0, raw)).tolist()
    for x in reversed(nodes[1:]):
        up, a, b = x.up.n, keep[x.n], drop[x.n]
        drop[up] += b
        keep[up] += a if a > b else b
    kept = [True]  # the root holds the page
    for x in nodes[1:]:
        kept.append(kept[x.up.n] and keep[x.n] > drop[x.n])
    return kept


def train(n_pages: int = TRAIN_PAGES, seed: int = 1) -> gbt.Trees:
    parsed = [parse(page, labels=True)[0] for page in html_layouts.pages(n_pages, seed)]
    y = np.array([x.label for nodes in parsed for x in nodes], np.float64)
    inner = np.array([x.up is not None for nodes in parsed for x in nodes])
    return gbt.fit(features(parsed)[inner], y[inner])


def texts(pages: list[str], model: gbt.Trees) -> list[str]:
    parsed = [parse(p or "") for p in pages]
    raw = model.raw(features([nodes for nodes, _ in parsed])) if parsed else np.empty(0)
    out, at = [], 0
    for nodes, blocks in parsed:
        kept = decode(nodes, raw[at:at + len(nodes)])
        at += len(nodes)
        out.append("\n".join(t for n, t in blocks if kept[n]))
    return out


def extract(pages: DataFrame, model: gbt.Trees | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    model = model or train()

    @F.arrow_udf("string")
    def main_text(column: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(column), 64):
            out += texts(column.slice(at, 64).to_pylist(), model)
        return pa.array(out, pa.string())

    out = pages.select("page_id", "url", main_text(F.coalesce(F.col("html"), F.lit(""))).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
