"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text. A linear classifier gives each block the cost of calling it
content and that of calling it boilerplate, from its own shape (length, links, sentence marks) and
from what encloses it (element names, words in class, id and role). These costs are the capacities
to the two terminals; neighbours in page order and in the document tree are joined by edges whose
capacity falls with their distance in the tree. The minimum cut is the cheapest labelling.

Blocks whose own cost outweighs all their edges are decided first and their edges moved to the
neighbours' terminals, which does not change the minimum; what is left is solved by augmenting paths.
Every page is handled on its own, in one pass with no shuffle.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title)(?=[\s/>])[^>]*>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attr>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?P<close>>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)", re.S | re.I)
# Elements whose text is never read; one that is not closed ends at its tag.
_DROPPED = "noscript|template|iframe|svg|object|canvas|audio|video|annotation|annotation-xml"
DROPPED = frozenset(_DROPPED.split("|"))
_DROPPED_TAG = re.compile(rf"<(/?)({_DROPPED})(?=[\s/>])((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.I)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
NAMED = frozenset("class id role itemprop aria-label".split())
_WORD = re.compile(r"[a-z]+")
# Element names of the HTML standard.
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt
fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav
ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSED_BY_BLOCK = {"p"}
CLOSED_BY_SAME = frozenset("li dt dd td th tr option p".split())
# Weights of enclosing elements and of words in their names; positive means content.
ELEMENT = {"article": 7.0, "main": 4.0, "nav": -16.0, "footer": -16.0, "aside": -16.0, "form": -16.0, "header": -6.0,
           "menu": -16.0, "dialog": -16.0, "button": -16.0, "select": -16.0, "label": -8.0, "fieldset": -8.0, "head": -20.0,
           "search": -16.0}
_GOOD, _BAD = 3.0, -16.0
NAME_WORDS = {
    **dict.fromkeys("article articlebody content entry main post story text".split(), _GOOD),
    **dict.fromkeys("""ad ads advert advertisement adverts advertising alert banner banners breadcrumb breadcrumbs comment
comments commentlist consent contentinfo cookie cookies disqus footer gdpr header login menu menus modal nav navbar
navigation newsletter notice notices notification overlay paywall popup promo promoted promotion recommended related
replies reply respond search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription
tags teaser toolbar widget widgets""".split(), _BAD),
}
OWN = {"p": 1.5, "blockquote": 1.5, "pre": 1.5, "h1": 1.0, "h2": 1.0, "h3": 1.0, "figcaption": 1.0}
NEAR, SMOOTH = 1.0, 1.5


@dataclass
class Block:
    text: str
    tag: str
    path: tuple[int, ...]     # numbers of the enclosing elements, outermost first
    weight: float             # of the enclosing elements
    links: int                # characters inside links


def _ends(page: str) -> dict[int, int]:
    """Where a dropped element that starts at a position ends; elements of one name nest."""
    ends, open_tags = {}, {}
    for m in _DROPPED_TAG.finditer(page):
        starts = open_tags.setdefault(m[2].lower(), [])
        if not m[1]:
            if not _SELF_CLOSED.search(m[3]):
                starts.append(m.start())
        elif starts:
            ends[starts.pop()] = m.end()
    return ends


def _names(attributes: str) -> set[str]:
    """Words in the attributes that name an element."""
    return {w for name, *values in _ATTRIBUTE.findall(attributes) if name.lower() in NAMED for w in _WORD.findall("".join(values).lower())}


def blocks(page: str) -> list[Block]:
    """Text blocks in page order: white space becomes one space, references are decoded.

    Formulas keep their text, drawings and embedded media have none.
    """
    out: list[Block] = []
    stack: list[tuple[str, int, float]] = []   # element, its number, weight of all enclosing
    parts: list[str] = []
    links = depth_a = number = 0

    def flush():
        nonlocal parts, links
        text = " ".join("".join(parts).split())
        if text:
            tag = next((t for t, _, _ in reversed(stack) if t in BLOCK), "")
            out.append(Block(text, tag, tuple(n for t, n, _ in stack if t in BLOCK), stack[-1][2] if stack else 0.0, links))
        parts, links = [], 0

    def pop(name, stop=()):
        nonlocal depth_a
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                depth_a -= sum(t == "a" for t, _, _ in stack[i:])
                del stack[i:]
                return
            if stack[i][0] in stop:
                return

    at, ends = 0, None
    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        if (text := m["text"]) is not None:
            text = html.unescape(text)
            parts.append(text)
            if depth_a:
                links += len(text)
            continue
        tag = m["tag"]
        if tag is None:
            if (m["raw"] or "").lower() == "textarea":
                parts.append(" ")
            continue
        tag = tag.lower()
        if tag in DROPPED:
            if not m["end"]:
                ends = _ends(page) if ends is None else ends
                at = ends.get(m.start(), at)
            continue
        if not m["close"]:        # the page ends inside a tag
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if m["end"]:
            if tag in BLOCK:
                flush()
            pop(tag, ("table",) if tag in ("td", "tr", "li", "p") else ())
            continue
        if tag in BLOCK:
            flush()
            if stack and any(t == "p" for t, _, _ in stack[-4:]):
                pop("p", ("table", "button"))
            if tag in CLOSED_BY_SAME:
                pop(tag, ("ul", "ol", "dl", "table", "select", "menu"))
        if tag in VOID or _SELF_CLOSED.search(m["attr"]) and tag not in BLOCK:
            continue
        weight = (stack[-1][2] if stack else 0.0) + ELEMENT.get(tag, 0.0)
        if tag != "body" and tag != "html" and m["attr"]:
            weight += sum(NAME_WORDS.get(w, 0.0) for w in _names(m["attr"]))
        number += 1
        depth_a += tag == "a"
        stack.append((tag, number, weight))
    flush()
    return out


def score(b: Block) -> float:
    """Log-odds of a block to be content."""
    n = len(b.text)
    value = b.weight + OWN.get(b.tag, 0.0) - 4.0 * min(1.0, b.links / n)
    value += min(2.0, 0.5 * math.log1p(n / 20)) - 1.5
    return value + (0.5 if b.text[-1] in ".!?\"'" else 0.0)


def edges_of(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours in page order, and the next block with the same parent element."""
    out, last = [], {}
    for i, b in enumerate(found):
        if i:
            a = found[i - 1]
            same = 0
            while same < min(len(a.path), len(b.path)) and a.path[same] == b.path[same]:
                same += 1
            out.append((i - 1, i, SMOOTH / (1 + max(len(a.path), len(b.path)) - same)))
        parent = b.path[:-1]
        if parent in last and last[parent] != i - 1:
            out.append((last[parent], i, NEAR))
        last[parent] = i
    return out


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) with the least sum of costs: -score if content, plus cut edges."""
    n = len(scores)
    value, near = list(scores), [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b and w > 0:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is not None or abs(value[i]) < sum(near[i].values()):
            continue
        label[i] = value[i] > 0
        for j, w in near[i].items():
            value[j] += w if label[i] else -w
            del near[j][i]
            queue.append(j)
        near[i] = {}
    left = [i for i in range(n) if label[i] is None]
    if left:
        side = _reachable({i: value[i] for i in left}, {i: near[i] for i in left})
        for i in left:
            label[i] = i in side
    return label


def _reachable(value: dict[int, float], near: dict[int, dict[int, float]]) -> set[int]:
    """Nodes on the source side of a minimum cut, by shortest augmenting paths."""
    source, sink = -1, -2
    flow = {i: dict(near[i]) for i in near}
    flow[source], flow[sink] = {}, {}
    for i, v in value.items():
        if v > 0:
            flow[source][i], flow[i][source] = v, 0.0
        else:
            flow[i][sink], flow[sink][i] = -v, 0.0
    while True:
        back = {source: source}
        queue = deque([source])
        while queue and sink not in back:
            a = queue.popleft()
            for b, w in flow[a].items():
                if w > 1e-12 and b not in back:
                    back[b] = a
                    queue.append(b)
        if sink not in back:
            return set(back)
        path, b = [], sink
        while b != source:
            path.append((back[b], b))
            b = back[b]
        least = min(flow[a][b] for a, b in path)
        for a, b in path:
            flow[a][b] -= least
            flow[b][a] = flow[b].get(a, 0.0) + least


def extract(page: str) -> str:
    """Main text of a page: content blocks in page order, joined by an empty line."""
    found = blocks(page)
    labels = minimum_cut([score(b) for b in found], edges_of(found))
    return "\n\n".join(b.text for b, keep in zip(found, labels) if keep)


def main_text(page: Column) -> Column:
    """The extracted text of an HTML column; a null or empty page gives an empty text."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([extract(p or "") for p in pages], dtype=object)

    return run(page)


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row; repeated rows and null ids stay as they are."""
    return (pages.select("page_id", "url", main_text(F.col(html_col)).alias("text"))
            .withColumn("n_chars", F.char_length("text").cast("bigint")))
