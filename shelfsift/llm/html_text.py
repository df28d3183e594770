"""Main text of web pages by composite text density."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsift.llm.common import map_frames

# Names of the markup language.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp noembed noframes iframe".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
             "span strike strong sub sup time tt u var br wbr img nobr".split())
NEVER = set("head script style noscript nav footer aside form button select option textarea iframe template svg canvas "
            "object audio video dialog menu title fieldset".split())
# Words of a class or an id that mark a block that isn't the article; of readers' comments; of adverts, within a line too.
_COMMENTS = r"comments?|commentlist|respond|disqus|replies"
_ADVERTS = r"ads?|advert\w*|adsense|sponsor\w*"
_OTHERS = (r"promo\w*|banner|cookies?|consent|gdpr|notices?|popup|modal|newsletter|subscribe|signup|login|nav\w*|menu\w*|"
           r"breadcrumbs?|side-?bar|sidebar\w*|aside|footer|site-?header|masthead|toolbar|social|shar(?:e|ing)|related|"
           r"recommend\w*|pagination|pager|widget|search|alert")
COMMENTS, ADVERTS, UNWANTED = (
    re.compile(rf"(?:^|[_-])(?:{words})(?:$|[_-])") for words in (_COMMENTS, _ADVERTS, f"{_COMMENTS}|{_ADVERTS}|{_OTHERS}"))
#: A name that tells what an element has or is laid out for, not what it is.
_LAYOUT = re.compile(r"^(?:has|with|no|without|hide|hidden|show|visible)[_-]|[_-](?:layout|enabled|active|open|closed|loaded)$")
ROLES = set("navigation complementary contentinfo search banner alert dialog alertdialog menu menubar toolbar".split())
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_LOOSE = re.compile(r"</?([a-zA-Z][^\s/>]*)[^>]*>")
#: Start tags that end an open element of these names.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
         "th": {"td", "th"}, "option": {"option"}}
_HEADINGS = {f"h{i}" for i in range(1, 7)}


class Node:
    """An element with its child elements and texts in order; the counts are of its whole subtree."""

    __slots__ = ("name", "parts", "parent", "gone", "marked", "comment", "main", "links_only",
                 "chars", "tags", "link_chars", "links", "density", "total")

    def __init__(self, name: str, parent: Node | None, attributes: str = ""):
        self.name, self.parent, self.parts = name, parent, []
        self.gone, self.marked, self.comment, self.main = name in NEVER, False, False, name in ("article", "main")
        if attributes and not attributes.isspace():
            self._judge({m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)})
        self.links_only = False
        self.chars = self.tags = self.link_chars = self.links = 0
        self.density = self.total = 0.0

    def _judge(self, values: dict[str, str]) -> None:
        """What the attributes say: not shown, marked as something else by a name or a role, or the article."""
        role = values.get("role", "").strip().lower()
        self.main = self.main or role in ("main", "article") or values.get("itemprop", "").lower() == "articlebody"
        if self.name in ("html", "body"):
            return
        self.gone = self.gone or "hidden" in values or values.get("aria-hidden", "").strip().lower() == "true" or bool(
            _UNSEEN.search(values.get("style", "")))
        names = [n for n in f"{values.get('class', '')} {values.get('id', '')}".lower().split() if not _LAYOUT.search(n)]
        self.main = self.main or any(n in ("article-body", "articlebody") for n in names)
        self.comment = self.name not in INLINE and any(map(COMMENTS.search, names))
        if self.name in INLINE:
            self.marked = any(map(ADVERTS.search, names))
        elif self.name in ("article", "main"):
            self.marked = self.comment
        else:
            self.marked = role in ROLES or "hidden" in names or any(map(UNWANTED.search, names))

    def children(self) -> list[Node]:
        """Child elements but for lists of links."""
        return [p for p in self.parts if isinstance(p, Node) and not p.links_only]


def parse(html: str) -> Node:
    """A tree of any markup: unclosed and crossed elements are closed where a block or a parent ends."""
    top = node = Node("html", None)
    at, size = 0, len(html)
    while at < size:
        begin = html.find("<", at)
        if begin != at:
            node.parts.append(unescape(html[at:begin if begin >= 0 else size]))
            if begin < 0:
                break
        m = _TOKEN.match(html, begin)
        if not m:
            m = _LOOSE.match(html, begin)
            at = m.end() if m else begin + 1
            if not m:
                node.parts.append("<")
            continue
        at = m.end()
        if m[1]:
            name = m[1].lower()
            up = node
            while up is not top and up.name != name:
                up = up.parent
            if up is not top:
                node = up.parent
        elif m[2]:
            name = m[2].lower()
            if name in ("html", "body") and node is not top:
                continue
            if name not in INLINE or name == "p":
                closes = _ENDS.get(name, set()) | {"p"}
                up = node
                while up is not top and (up.name in INLINE or up.name in closes):
                    closed = up.name in closes
                    up = up.parent
                    if closed:
                        node = up
            if name in VOID:
                node.parts.append(Node(name, node))
            elif name in RAW:
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
                at = end.end() if end else size
            elif not m[3].endswith("/") or name not in ("svg", "path"):
                child = Node(name, node, m[3])
                node.parts.append(child)
                node = child
    return top


def spare(top: Node) -> None:
    """Takes the mark from what contains the article: the longest one, if all articles are marked and most text lies in it."""
    order, articles, free = [], [], 0
    stack = [(top, False, False)]
    while stack:
        node, marked, comment = stack.pop()
        marked, comment = marked or node.marked, comment or node.comment
        order.append(node)
        if node.main and not marked:
            return
        if node.main and not comment:
            articles.append(node)
        for part in node.parts:
            if isinstance(part, str):
                free += 0 if marked else len(part.strip())
            elif not part.gone:
                stack.append((part, marked, comment))
    for node in reversed(order):
        measure(node)
    article = max(articles, key=lambda n: n.chars - n.link_chars, default=None)
    if article and article.chars - article.link_chars > free:
        while article:
            article.marked, article = False, article.parent


def prune(top: Node) -> None:
    """Takes out what is never the article and marks lists of links; of an article's own header the headings stay."""
    order, stack = [], [(top, False)]
    while stack:
        node, inside = stack.pop()
        order.append(node)
        inside = inside or node.main
        kept = []
        for part in node.parts:
            if isinstance(part, Node):
                if part.gone or part.marked:
                    kept.append(" ")
                    continue
                if part.name == "header":
                    if not inside:
                        continue
                    part.parts = [p for p in part.parts if isinstance(p, Node) and p.name in _HEADINGS]
                stack.append((part, inside))
            kept.append(part)
        node.parts = kept
    for node in reversed(order):
        measure(node)
        node.links_only = (
            node.name in ("ul", "ol", "div", "section", "table") and node.links >= 3 and node.link_chars > 0.7 * node.chars)


def without_link_lists(top: Node, whole: Node) -> None:
    """Takes the lists of links out of all but ``whole``."""
    stack = [top]
    while stack:
        node = stack.pop()
        if node is not whole:
            node.parts = [p for p in node.parts if isinstance(p, str) or not p.links_only]
            stack += node.children()


def measure(node: Node) -> None:
    node.chars = node.tags = node.link_chars = node.links = 0
    for part in node.parts:
        if isinstance(part, Node):
            if part.links_only:
                continue
            node.chars += part.chars
            node.tags += part.tags + 1
            node.link_chars += part.link_chars
            node.links += part.links
        else:
            node.chars += len(part) if not part.isspace() else 0
    if node.name == "a":
        node.links, node.link_chars = node.links + 1, node.chars


def weigh(body: Node) -> list[Node]:
    """Density of every node below ``body``, and the sum of its children's."""
    order, stack = [], [body]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += node.children()
    share = body.link_chars / max(1, body.chars)
    for node in reversed(order):
        chars, tags = node.chars, max(1, node.tags)
        links, link_chars = max(1, node.links), max(1, node.link_chars)
        plain = max(1, chars - node.link_chars)
        base = math.log(chars * node.link_chars / plain + share * chars + math.e)
        odds = chars * tags / (link_chars * links)
        node.density = chars / tags * (math.log(odds) / math.log(base) if odds > 1 and base > 1 else 0.0) if chars else 0.0
        node.total = sum(c.density for c in node.children())
    return order


def text_of(nodes: list[Node]) -> str:
    """One line per block, white space folded, in page order."""
    blocks: list[list[str]] = [[]]
    for top in nodes:
        blocks.append([])
        stack: list = [top]
        while stack:
            part = stack.pop()
            if part is None:
                blocks.append([])
            elif isinstance(part, str):
                blocks[-1].append(part)
            elif part.name == "br":
                blocks[-1].append(" ")
            else:
                block = part.name not in INLINE
                if block:
                    blocks.append([])
                    stack.append(None)
                stack += reversed(part.parts)
        blocks.append([])
    lines = (" ".join("".join(block).split()) for block in blocks)
    return "\n".join(line for line in lines if line)


def main_text(html: str | None) -> str:
    """The article of a page; empty for null, empty and textless pages.

    The node of the largest density sum is the article's core, and nothing in it is dropped. The least density on its
    path to the body is the threshold: what stands beside that path and reaches it belongs to the article, and so do
    the headings there. Within an element that names itself the article all but lists of links beside the core stays.
    """
    if not html:
        return ""
    top = parse(html)
    spare(top)
    prune(top)
    order = weigh(top)
    inner = [n for n in order if n.main and n.chars]
    root = max(inner, key=lambda n: n.chars) if inner else top
    inside = order if root is top else weigh(root)
    core = max(inside, key=lambda n: n.total)
    page = core.name in ("html", "body") and not root.main
    if not root.main:
        without_link_lists(root, None if page else core)
    if not core.total:
        return text_of([root])
    path = [core]
    while path[-1] is not root:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    chosen = [core]
    for below, node in zip(path, path[1:]):
        around = []
        for child in node.parts:
            if child is below:
                around += chosen
            elif isinstance(child, Node):
                if child.chars and not child.links_only and (
                        root.main and root.name != "main" or child.density >= threshold or child.name in _HEADINGS
                        or root.main and child.name in ("p", "blockquote", "pre")):
                    around.append(child)
            elif root.main and child.strip():
                around.append(_loose_text(child))
        chosen = around
    return text_of(chosen)


def _loose_text(text: str) -> Node:
    node = Node("span", None)
    node.parts = [text]
    return node


def extract(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """``keys`` and the main text of every page, from its whole markup, however long.

    Null, empty and textless pages have an empty text. Each row stands alone: repeated rows and equal keys have equal
    results, columns but ``keys`` and ``html`` are left out, and an empty table gives an empty result. Of several nodes with
    the largest density sum the first in page order is the core.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(text=list(map(main_text, frame.pop("__html"))))

    return map_frames(pages.select(*keys, F.col(html).alias("__html")), keys, run, "text string")
