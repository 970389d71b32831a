"""Operator 7: main text of web pages by tree scoring.

Paragraphs earn points for their length and their commas and pass them to their ancestors, less with each level. A
container's points are discounted by the share of its text that is in links. The best container is kept, and of its
siblings those that score near it or are running text by themselves.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import slices

#: Characters below which a paragraph earns nothing; points for each 100 characters, at most.
LEAST, LENGTH_POINTS = 25, 3
#: Share of its points that a paragraph gives to its parent, its parent's parent and so on.
PASSED = (1.0, 0.5, 1 / 6, 1 / 9)
#: A sibling of the best container is kept if it scores this share of it.
SIBLING = 0.2

_NAME = re.compile(r"[a-zA-Z][^\s/><]*")
_MARK = re.compile(r"""=\s*+(["'])|>""")
_NAMED = re.compile(r"""\b(?:class|id)\s*+=\s*+("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_RAW = ("script", "style", "noscript", "template", "iframe", "svg", "textarea", "title")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in _RAW}
_BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
_PARAGRAPH = frozenset("p pre td blockquote div section article li dd".split())
#: Never main text; and what is away only while it doesn't hold most of the page's running text.
_AWAY, _DOUBTFUL = frozenset("nav footer select button".split()), frozenset("aside form".split())
_WHOLE = frozenset(("body", "main", "article"))
_UNLIKELY = re.compile(r"(?:^|[_-])(?:ad|ads|advert\w*|banner|breadcrumbs?|comments?|cookie\w*|footer|menu|nav\w*|pager|popup|promo\w*|related|share|sharing|sidebar|social|sponsor\w*|subscribe)(?:$|[_-])", re.I)
#: Classes that tell of another part of the page, not of this one.
_STATE = re.compile(r"(?:has|no|not|with|without|is)[_-]", re.I)
#: A doubtful element is kept if it holds this share of the page's text outside of links; it scores this share of its points.
MOST, DOUBT = 0.5, 0.5


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    #: Never main text; its name or kind speaks against it.
    away: bool
    doubtful: bool = False
    #: Text that is directly in it (between its blocks), and in links; then those of all below it.
    own: list[str] = field(default_factory=list)
    links: int = 0
    size: int = 0
    all_links: int = 0
    score: float = 0.0


class _Scanner:
    """Finds where tags end. It remembers what is ahead, so any page takes one pass."""

    def __init__(self, html: str):
        self.html, self.ahead = html, -1
        self.last = {quote: html.rfind(quote) for quote in "\"'"}

    def bracket(self, at: int) -> int:
        """The next closing bracket, or the page's length; ``at`` never goes back."""
        if self.ahead < at:
            found = self.html.find(">", at)
            self.ahead = len(self.html) if found < 0 else found
        return self.ahead

    def tag_end(self, at: int) -> int:
        """The bracket that ends the tag whose attributes begin at ``at``, or the page's length.

        Brackets in quoted values don't count. A value whose closing mark is missing, or is plainly that of a later
        value (what follows it can't follow a value), ends the tag at the next bracket.
        """
        html = self.html
        while mark := _MARK.search(html, at):
            quote = mark[1]
            if quote is None:
                return mark.start()
            begin = mark.end()
            close = html.find(quote, begin) if begin <= self.last[quote] else -1
            if close < 0 or html[close + 1 : close + 2] not in ("", " ", "\t", "\n", "\r", "\f", "/", ">"):
                return self.bracket(begin)
            at = close + 1
        return len(html)


def _named(attributes: str) -> bool:
    """Whether a class or id names a part of no interest."""
    return any(_UNLIKELY.search(name) and not _STATE.match(name) for value in _NAMED.findall(attributes) for name in value.strip("\"'").split())


def parse(html: str) -> tuple[list[Node], list[tuple[int, str]], str]:
    """Block elements in document order (0 is the root), the pieces of text with their block, and the title."""
    nodes = [Node("html", -1, False)]
    pieces: list[tuple[int, str]] = []
    stack, opened = [0], Counter()
    title, in_link, at, size, scan = "", 0, 0, len(html), _Scanner(html)
    unclosed: set[str] = set()

    def text(raw: str) -> None:
        piece, node = unescape(raw), nodes[stack[-1]]
        pieces.append((stack[-1], piece))
        node.own.append(piece)
        if in_link:
            node.links += len(piece.strip())

    def leave(depth: int) -> None:
        for i in stack[depth:]:
            opened[nodes[i].tag] -= 1
        del stack[depth:]

    while at < size:
        begin = html.find("<", at)
        if begin != at:
            text(html[at : begin if begin >= 0 else size])
            if begin < 0:
                break
            at = begin
        sign = html[at + 1 : at + 2]
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            at = size if end < 0 else end + 3
            continue
        closing = sign == "/"
        if sign in ("!", "?") or closing and not html[at + 2 : at + 3].isalpha():
            at = scan.bracket(at) + 1
            continue
        if scan.bracket(at) == size:
            # No tag ends any more: what looks like one is left out, up to the next that does.
            if sign == "/" or sign.isalpha():
                begin = html.find("<", at + 1)
                at = size if begin < 0 else begin
            else:
                text("<")
                at += 1
            continue
        name = _NAME.match(html, at + 1 + closing)
        if name is None:
            text("<")
            at += 1
            continue
        tag = name[0].lower()
        end = scan.tag_end(name.end())
        attributes, at = html[name.end() : end], end + 1
        if closing:
            if tag == "a":
                in_link = 0
            elif tag in _BLOCK and opened[tag] > 0:
                depth = len(stack) - 1
                while nodes[stack[depth]].tag != tag:
                    depth -= 1
                leave(depth)
        elif tag in _RAW and not attributes.rstrip().endswith("/"):
            found = None if tag in unclosed else _RAW_END[tag].search(html, at)
            if found is None and tag not in ("script", "style"):
                unclosed.add(tag)  # its content is taken for the page's
                continue
            inner = html[at : found.start() if found else size]
            if tag == "title" and not title:
                title = " ".join(unescape(inner).split())
            at = scan.bracket(found.end()) + 1 if found else size
        elif tag == "br":
            pieces.append((stack[-1], "\n"))
            nodes[stack[-1]].own.append("\n")
        elif tag == "a":
            in_link = 1
        elif tag in _BLOCK and tag != "html":
            if tag == "body":
                leave(1)
            else:
                top = nodes[stack[-1]].tag
                if top in ("p", "head") or tag == top and tag in ("li", "dd", "dt", "tr", "td", "th"):
                    leave(len(stack) - 1)  # closed by what follows
            in_link = 0
            nodes.append(Node(tag, stack[-1], tag in _AWAY, tag in _DOUBTFUL or tag not in _WHOLE and _named(attributes)))
            stack.append(len(nodes) - 1)
            opened[tag] += 1
    return nodes, pieces, title


def _density(node: Node) -> float:
    return min(1.0, node.all_links / node.size) if node.size else 0.0


def extract_text(html: str | None) -> tuple[str | None, str | None, float | None]:
    """(title, text, score of the container) of a page; nulls for null.

    If no paragraph is left, doubtful elements have hidden them: those are taken in too.
    """
    if html is None:
        return None, None, None
    nodes, pieces, title = parse(html)
    text, top = _best(nodes, pieces, True)
    if not top and any(node.doubtful for node in nodes):
        again = _best(nodes, pieces, False)
        if again[1] or not text:
            text, top = again
    return title, text, top


def _best(nodes: list[Node], pieces: list[tuple[int, str]], doubt: bool) -> tuple[str, float]:
    """Text and score of the best container; doubtful elements that hold little of the page are away if ``doubt``."""
    texts = [" ".join("".join(node.own).split()) for node in nodes]
    for node, own in zip(nodes, texts, strict=True):
        node.size, node.all_links, node.score = len(own), min(node.links, len(own)), 0.0
    for node in reversed(nodes[1:]):
        parent = nodes[node.parent]
        parent.size += node.size
        parent.all_links += node.all_links
    most = MOST * (nodes[0].size - nodes[0].all_links)
    away = [False] * len(nodes)
    for i, node in enumerate(nodes[1:], 1):
        away[i] = away[node.parent] or node.away or doubt and node.doubtful and node.size - node.all_links <= most
    scored = set()
    for i, (node, own) in enumerate(zip(nodes, texts, strict=True)):
        if not i or away[i] or node.tag not in _PARAGRAPH or len(own) < LEAST:
            continue
        points = (1 + own.count(",") + min(len(own) / 100, LENGTH_POINTS)) * (1 - min(1.0, node.links / len(own)))
        up = node.parent
        if node.tag in ("div", "section", "article"):
            node.score += points  # text right in a container counts for the container
            scored.add(id(node))
        for share in PASSED:
            if up < 0:
                break
            nodes[up].score += points * share
            scored.add(id(nodes[up]))
            up = nodes[up].parent
    best, top = 0, 0.0
    for i, node in enumerate(nodes):
        if doubt and node.doubtful:
            node.score *= DOUBT
        if id(node) in scored and not away[i] and (value := node.score * (1 - _density(node))) > top:
            best, top = i, value
    chosen = {best}
    if best:
        for i, node in enumerate(nodes):
            if i == best or node.parent != nodes[best].parent or away[i]:
                continue
            density = _density(node)
            running = node.tag == "p" and (node.size > 80 and density < 0.25 or 0 < node.size <= 80 and density == 0 and texts[i].endswith((".", "!", "?")))
            if running or id(node) in scored and node.score * (1 - density) >= max(10.0, SIBLING * top):
                chosen.add(i)
    inside = [False] * len(nodes)
    for i, node in enumerate(nodes):
        dropped = away[i] or node.tag in ("ul", "ol", "table", "div") and i not in chosen and _density(node) > 0.5
        inside[i] = not dropped and (i in chosen or node.parent >= 0 and inside[node.parent])
    lines: list[list[str]] = []
    last = -1
    for i, text in pieces:
        if not inside[i]:
            last = -1
            continue
        if i != last:
            lines.append([])
            last = i
        lines[-1].append(text)
    out = [" ".join(line.split()) for block in lines for line in "".join(block).split("\n\n")]
    return "\n".join(line for line in out if line), round(top, 6)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, title, text, score), a row for each row.

    A null page has nulls; an empty one, or one without text, has empty title and text and score 0. Without any
    paragraph of ``LEAST`` characters all text outside of navigation and the like is kept, with score 0. Forms, asides
    and elements named like parts of no interest are left out only while they hold less than half of the page's text,
    and not if that leaves no paragraph. Of containers of equal score the first is kept. Pages of any length and depth
    are read whole, in time that grows with their length; broken markup never fails and isn't taken for text.
    Repeated rows and null ids are carried; an empty table gives no rows; other columns aren't read.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                titles, texts, scores = zip(*map(extract_text, part.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(titles, pa.string()), pa.array(texts, pa.string()), pa.array(scores, pa.float64())], names=["page_id", "title", "text", "score"])

    return pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")).mapInArrow(run, f"page_id {kind}, title string, text string, score double")
