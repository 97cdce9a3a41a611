"""Main text of web pages by minimum-cut labelling.

A page is read once into text blocks with their enclosing elements. A logistic classifier with fixed weights (there
are no labelled pages to learn from) gives each block log odds of being content; these become capacities to
the two terminals. Blocks that follow each other, and blocks under one container (through a node for the container), are
joined by smoothness edges, which weigh as much as the evidence of a short block: a line without a full stop or a list of links
inside an article goes with the article, a sentence inside a menu with the menu. The minimum cut separates content from boilerplate. Blocks whose terminal capacity
is at least the sum of their edges keep its side in every minimum cut, so they are folded into their neighbours first and the
flow runs over what is left.
"""

from __future__ import annotations

import html as _html
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

# fixed values: element names and words in class, id or role
BLOCK = frozenset("address article aside blockquote body canvas center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = "script style head title select datalist textarea button"
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CONTENT_TAGS = frozenset("article main".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
CONTENT_WORDS = frozenset("article content main post entry story body text maincontent articlebody mainbody".split())
BOILER_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner nav navbar navigation menu menubar topbar toolbar breadcrumb breadcrumbs footer foot header masthead sidebar side aside rail widget widgets related recommended recommendations more share sharing social comment comments commentlist reply replies respond discussion disqus cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login register form search pagination pager copyright legal disclaimer tags contentinfo complementary navigation hidden".split())

_TAG = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+[^>]*+)>", re.S)
# an attribute's name and value; quoted values are taken whole, so nothing within them is read as an attribute
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_SKIP = frozenset(SKIPPED.split())
# without an end tag these take the rest of the page
_RAW = frozenset("script style textarea title".split())
_END_OF = {t: re.compile(rf"</{t}\s*>", re.I) for t in _SKIP}

#: weights of the classifier: constant, in content, in boilerplate, per doubling of words (up to 6), sentence ends, heading, link share
W0, W_CONTENT, W_BOILER, W_WORDS, W_SENTENCE, W_HEADING, W_LINKS = -2.6, 2.0, -7.0, 0.8, 1.6, 0.8, -2.0
#: smoothness: between neighbours in one container and across containers, and between a block and its container
S_SAME, S_ACROSS, S_CONTAINER = 1.0, 0.3, 0.8


def _mark(tag: str, attrs: str) -> int:
    """1 for an element that holds content, -1 for boilerplate, 0 for neither."""
    words: set[str] = set()
    if attrs and tag not in ("html", "body"):
        for m in _ATTR.finditer(attrs):
            name = m.group(1).lower()
            if name == "hidden" or (name == "style" and _UNSEEN.search(m.group(2) or m.group(3) or m.group(4) or "")):
                return -1
            if name in ("class", "id", "role"):
                words.update(_SPLIT.split((m.group(2) or m.group(3) or m.group(4) or "").lower()))
    good = tag in CONTENT_TAGS or bool(words & CONTENT_WORDS)
    bad = tag in BOILER_TAGS or bool(words & BOILER_WORDS)
    if tag in CONTENT_TAGS and not words & BOILER_WORDS:
        return 1
    if bad and tag in BOILER_TAGS:
        return -1
    return 0 if good and bad else 1 if good else -1 if bad else 0


class Block:
    __slots__ = ("text", "content", "boiler", "container", "heading", "links")

    def __init__(self, text: str, content: bool, boiler: bool, container: int, heading: bool, links: int):
        self.text, self.content, self.boiler, self.container, self.heading, self.links = text, content, boiler, container, heading, links


def blocks(html: str) -> list[Block]:
    """Text blocks in page order. Works on broken markup: missing end tags close with their parents, stray ones are ignored.

    A skipped element without an end tag ends at the next block; only raw text goes to the end of the page.
    """
    out: list[Block] = []
    # stack of block elements: tag, number of the element, in content, in boilerplate, marked as boilerplate itself
    stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
    open_tags: dict[str, int] = {}
    number, parts, links, in_link, heading = 0, [], 0, False, False
    endless: set[str] = set()  # elements with no end tag from here on
    skipping = False

    def flush() -> None:
        nonlocal parts, links, heading
        if parts:
            text = "".join(parts)
            if "&" in text:
                text = _html.unescape(text)
            text = " ".join(text.split())
            if text:
                top = stack[-1]
                # paragraphs and the like stand for their parent as containers, unless they are set apart from it
                at = len(stack) - 1
                while at and stack[at][0] in _LEAVES and not stack[at][4]:
                    at -= 1
                out.append(Block(text, top[2], top[3], stack[at][1], heading, links))
            parts, links = [], 0
        heading = False

    def pop() -> None:
        open_tags[stack.pop()[0]] -= 1

    pos, n, last = 0, len(html), html.rfind(">")
    while pos < n:
        m = _TAG.search(html, pos) if pos <= last else None
        if m is None:
            chunk, nxt = html[pos:], n
        else:
            chunk, nxt = html[pos:m.start()], m.end()
        if chunk and not skipping:
            parts.append(chunk)
            if in_link:
                links += len(chunk)
        pos = nxt
        if m is None or m.group(2) is None:
            continue
        tag, closing = m.group(2).lower(), bool(m.group(1))
        if tag in _SKIP:
            if not closing and not m.group(3).endswith("/"):
                end = None if tag in endless else _END_OF[tag].search(html, pos)
                if end is None:
                    endless.add(tag)
                    if tag == "head":
                        continue
                flush()
                if end:
                    pos = end.end()
                elif tag in _RAW:
                    pos = n
                else:
                    skipping = True
            continue
        if tag == "a":
            in_link = not closing
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in BLOCK or (skipping and tag in ("option", "optgroup")):
            continue
        skipping = False
        flush()
        in_link = False
        if closing:
            if open_tags.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in VOID:
            continue
        if stack[-1][0] == "p":
            pop()
        if stack[-1][0] in CLOSES.get(tag, ()):
            pop()
        number += 1
        mark = _mark(tag, m.group(3))
        _, _, content, boiler, _ = stack[-1]
        if tag == "header" and not content and mark == 0:
            mark = -1
        stack.append((tag, number, content or mark > 0, boiler or mark < 0, mark < 0))
        open_tags[tag] = open_tags.get(tag, 0) + 1
        heading = tag in _HEADINGS
    flush()
    return out


_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th tr figcaption".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_STOP = re.compile(r"[.!?…。](?:\s|$)")


def log_odds(b: Block) -> float:
    words = b.text.count(" ") + 1
    z = W0 + W_WORDS * min(6, words.bit_length())
    if b.content:
        z += W_CONTENT
    if b.boiler:
        z += W_BOILER
    if _STOP.search(b.text):
        z += W_SENTENCE
    if b.heading:
        z += W_HEADING
    return z + W_LINKS * min(1.0, b.links / len(b.text))


def minimum_cut(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: a node with value u pays |u| for the label against its sign, an edge its weight if its ends differ.

    Ties go to the smallest set of content nodes (those reachable from the source in the residual graph).
    """
    n = len(unary)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    label: list[bool | None] = [None] * n
    pull = list(unary)
    weight = [sum(w for _, w in x) for x in near]
    ready = deque(i for i in range(n) if abs(pull[i]) > weight[i])
    while ready:  # nodes whose own side outweighs all their edges
        i = ready.popleft()
        if label[i] is not None:
            continue
        label[i] = pull[i] > 0
        for j, w in near[i]:
            if label[j] is None:
                pull[j] += w if label[i] else -w
                weight[j] -= w
                if abs(pull[j]) > weight[j] + 1e-12:
                    ready.append(j)
    left = [i for i in range(n) if label[i] is None]
    if not left:
        return [bool(x) for x in label]
    place = {v: k for k, v in enumerate(left)}
    s, t = len(left), len(left) + 1
    to: list[int] = []
    cap: list[float] = []
    adj: list[list[int]] = [[] for _ in range(t + 1)]

    def arc(a: int, b: int, c: float, back: float) -> None:
        adj[a].append(len(to))
        to.append(b)
        cap.append(c)
        adj[b].append(len(to))
        to.append(a)
        cap.append(back)

    for v in left:
        if pull[v] > 0:
            arc(s, place[v], pull[v], 0.0)
        elif pull[v] < 0:
            arc(place[v], t, -pull[v], 0.0)
        for j, w in near[v]:
            if j > v and label[j] is None:
                arc(place[v], place[j], w, w)
    tiny = 1e-9
    while True:  # blocking flows over the level graph
        level = [-1] * (t + 1)
        level[s] = 0
        queue = deque([s])
        while queue:
            x = queue.popleft()
            for e in adj[x]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[t] < 0:
            break
        cursor = [0] * (t + 1)
        path: list[int] = []
        x = s
        while True:
            if x == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                path, x = [], s
                continue
            while cursor[x] < len(adj[x]):
                e = adj[x][cursor[x]]
                if cap[e] > tiny and level[to[e]] == level[x] + 1:
                    break
                cursor[x] += 1
            else:
                if not path:
                    break
                e = path.pop()
                x = to[e ^ 1]
                cursor[x] += 1
                continue
            path.append(e)
            x = to[e]
    for v in left:
        label[v] = level[place[v]] >= 0
    return [bool(x) for x in label]


def graph(found: list[Block]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Unary values and edges; containers with several blocks come after the blocks as nodes of their own."""
    unary = [log_odds(b) for b in found]
    edges = [(i, i + 1, S_SAME if a.container == b.container else S_ACROSS) for i, (a, b) in enumerate(zip(found, found[1:]))]
    members: dict[int, list[int]] = {}
    for i, b in enumerate(found):
        members.setdefault(b.container, []).append(i)
    for own in members.values():
        if len(own) > 1:
            edges.extend((i, len(unary), S_CONTAINER) for i in own)
            unary.append(0.0)
    return unary, edges


def main_text(html: str | None) -> str:
    """The blocks labelled content, joined by one space; empty for null, empty or blank pages."""
    found = blocks(html) if html else []
    if not found:
        return ""
    label = minimum_cut(*graph(found))
    return " ".join(b.text for b, keep in zip(found, label) if keep)


def extract_main_text(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with the main text beside its columns (a column of that name is replaced).

    Null, empty and blank pages give an empty text; pages of any length are read whole. Rows are independent: repeated ones get equal
    texts; null ids and urls pass through; an empty table gives an empty result.
    """
    bounded_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield pd.Series([main_text(v) for v in values], dtype=object)

    return pages.withColumn(out_col, extract(F.col(html_col)))
