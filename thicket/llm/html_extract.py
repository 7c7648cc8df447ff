"""Main text of HTML pages by composite text density.

A page becomes a tree of elements, read as leniently as browsers do: paragraphs and list items close
each other, formatting elements that were never closed end with their block, and what is missing
at the end is closed. Elements that never hold the article (menus, headers and footers of the page,
sidebars, notices, adverts, comments, scripts, styles) are left out by tag, role and name. What may be
either stays in the tree until its text is counted: a form goes if it has little text for its controls, and an
element inside an article whose name only hints at something else (a notice, a discussion, related work) goes if
links hold much of its text or it has controls.

The density of an element is its characters per tag, adjusted by the share and the place of its link text:
``c / t * ln(c * t / (lc * lt)) / (1 + ln(base))`` with ``base = ln(c * lc / nlc + lcb * c / cb + e)``, where c, t are the
element's characters and tags, lc, lt those in links, nlc the characters outside links, and lcb, cb those of
the body. (The 1 keeps pages without links, whose base is 1, from having no bound.) A density sum adds up
the densities of an element's children. The element with the largest sum is the best guess; the smallest
density on its path to the body is the threshold above which the densest subtrees count as article, and the
element that holds all of these is the main text; or the article or main element that the best guess is
in, where the page has one. A page's only title goes before it, if it stands there.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the HTML standard: elements without content, and those that begin a new line.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li",
    "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CLOSES_P = BLOCK - {"caption", "dd", "dt", "legend", "li", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "html"}
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
ENDS_WITH = {"p", "li", "dt", "dd", "td", "th", "tr"}
IN_HEAD = {"base", "link", "meta", "noscript", "script", "style", "template", "title"}
#: Elements that hold no article, by tag, role, and words of their class and id.
NO_TEXT = {
    "script", "style", "noscript", "template", "head", "title", "iframe", "object", "embed", "svg", "canvas", "audio", "video",
    "map", "select", "datalist", "textarea", "button", "input", "nav", "aside", "footer", "menu", "dialog", "search", "noframes",
}
NO_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form", "status", "toolbar", "note"}
NO_NAME = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adbox", "banner", "banners", "sponsor", "sponsored", "promo",
    "promotion", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "popup", "modal", "overlay", "newsletter", "subscribe",
    "subscription", "signup", "login", "sidebar", "sidebars", "aside", "menu", "menus", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs",
    "footer", "masthead", "topbar", "toolbar", "comment", "comments", "commentlist", "disqus", "respond", "replies", "discussion", "share", "sharing",
    "social", "related", "recommended", "recommendations", "widget", "widgets", "pagination", "pager", "paging", "form", "search", "copyright",
    "disclaimer", "skip", "hidden", "teaser", "outbrain", "taboola",
}
#: Names and roles that say little inside an article.
HINTS = {"notice", "notices", "discussion", "related", "teaser", "widget", "widgets", "search", "disclaimer", "copyright", "share", "sharing", "form", "banner"}
HINT_ROLES = {"note", "status"}
CONTROLS = {"input", "button", "select", "textarea"}
FORM_CHARS = 200  # characters for each control, from which a form is text with controls in it
LINK_SHARE = 1 / 3
NO_HEADER = {"header", "pageheader", "siteheader"}
KEEPS_HEADER = {"article", "main"}
WHOLE = {"html", "body", "article", "main"}
FORMATTING = {"a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "strike", "strong", "tt", "u", "span"}
SPLIT_NAME = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
SPACE = re.compile(r"\s+")


class Node:
    """An element: its tag, children (elements and strings), and the counts that the densities need."""

    __slots__ = ("tag", "parent", "children", "chars", "tags", "link_chars", "link_tags", "density", "total", "controls", "doubt", "has_text")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent, self.children = tag, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.controls, self.doubt, self.has_text = 0, False, False

    def goes(self) -> bool:
        """Whether an element that may be either is no part of an article, once its text is counted."""
        if self.tag == "form":
            return self.controls > 0 and self.chars < FORM_CHARS * self.controls
        return self.doubt and (self.controls > 0 or self.link_chars > LINK_SHARE * self.chars)


def _names(attrs: list[tuple[str, str | None]]) -> set[str]:
    return {w.lower() for k, v in attrs if k in ("class", "id") and v for w in SPLIT_NAME.split(v)}


class _Tree(HTMLParser):
    """Builds the tree; text of elements that hold no article is left out while reading."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None)
        self.body: Node | None = None
        self.skipped: list[str] = []

    def _no_article(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool | None:
        """Whether an element is left out; None if its text decides."""
        if tag in NO_TEXT:
            return True
        if tag in WHOLE:
            return False
        inside = self.at
        while inside is not None and inside.tag not in KEEPS_HEADER:
            inside = inside.parent
        names = _names(attrs) - ({"form"} if tag == "form" else set())
        if inside is None and (tag == "header" or names & NO_HEADER):
            return True
        values = dict(attrs)
        hidden = "hidden" in values or (values.get("aria-hidden") or "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style") or "", re.I)
        words, role = names & NO_NAME, (values.get("role") or "").lower()
        if hidden or not (words or role in NO_ROLE):
            return bool(hidden)
        while inside is not None and inside.tag != "article":
            inside = inside.parent
        hints = words <= HINTS and (role not in NO_ROLE or role in HINT_ROLES)
        return None if inside is not None and hints else True

    def _close(self, tags: set[str], stop: set[str]) -> None:
        """Ends the nearest open element of ``tags``, unless one of ``stop`` is nearer."""
        node = self.at
        while node.parent is not None and node.tag not in stop:
            if node.tag in tags:
                self.at = node.parent
                return
            node = node.parent

    def _goes_on(self, tag: str) -> bool:
        """Whether a start tag nests in what is being left out; ends that if the tag closes it."""
        first, alone = self.skipped[0], len(self.skipped) == 1
        if first == "head" and tag not in IN_HEAD or alone and (first == "p" and tag in CLOSES_P or first in SIBLINGS and tag == first):
            self.skipped = []
        return bool(self.skipped) and tag == first and tag not in VOID

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.skipped and self._goes_on(tag):
            self.skipped.append(tag)
            return
        if self.skipped or tag == "html":
            return
        if tag == "body":
            if self.body is None:
                self.body = Node("body", self.root)
                self.root.children.append(self.body)
                self.at = self.body
            return
        if tag in CLOSES_P:
            self._close({"p"}, {"td", "th", "body"})
        if tag in SIBLINGS:
            tags, stop = SIBLINGS[tag]
            while (before := self.at) is not None:
                self._close(tags, stop)
                if self.at is before:
                    break
        if tag in BLOCK:  # formatting that its block has left open does not hold the blocks that follow
            while self.at.tag in FORMATTING and self.at.parent is not None and self.at.parent.tag not in FORMATTING and not self.at.has_text:
                self.at = self.at.parent
        if tag in VOID:
            self.at.controls += tag in CONTROLS
            self.at.children.append(Node(tag, self.at))
            return
        left_out = self._no_article(tag, attrs)
        if left_out:
            self.at.controls += tag in CONTROLS
            self.skipped.append(tag)
            return
        node = Node(tag, self.at)
        node.doubt = left_out is None
        self.at.children.append(node)
        self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if not self.skipped:
            self.handle_starttag(tag, attrs)  # a slash does not end an element that is not void

    def handle_endtag(self, tag: str) -> None:
        if self.skipped:
            if tag in self.skipped:
                while self.skipped.pop() != tag:
                    pass
            elif tag in WHOLE or self.skipped[0] in ENDS_WITH and tag in BLOCK and tag not in ENDS_WITH:  # it was never closed
                self.skipped = []
                self.handle_endtag(tag)
            return
        if tag in ("body", "html"):
            self.at = self.body or self.root
            return
        if tag in VOID:
            return
        self._close({tag}, {"body"} if tag in BLOCK else BLOCK - {"p"} | {"p"})

    def handle_data(self, data: str) -> None:
        if self.skipped:
            return
        self.at.children.append(data)
        node = self.at if data.strip() else None
        while node is not None and not node.has_text:
            node.has_text, node = True, node.parent


def parse(html: str) -> Node:
    """The body of a page as a tree, without what never holds the article."""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.body or tree.root


def _ordered(body: Node) -> list[Node]:
    """All elements, parents before their children."""
    out = [body]
    for node in out:  # grows meanwhile
        out += [c for c in node.children if isinstance(c, Node)]
    return out


def _count(nodes: list[Node]) -> None:
    """Counts from the leaves up, without children that turn out to be no part of an article."""
    for node in reversed(nodes):
        link = node.tag == "a"
        node.children = [c for c in node.children if isinstance(c, str) or not c.goes()]
        for child in node.children:
            if isinstance(child, str):
                n = len(SPACE.sub("", child))
                node.chars += n
                node.link_chars += n * link
            else:
                node.chars += child.chars
                node.tags += child.tags + 1
                node.link_chars += child.chars if link else child.link_chars
                node.link_tags += child.link_tags + (child.tag == "a")
                node.controls += child.controls


def _score(nodes: list[Node]) -> None:
    body = nodes[0]
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in reversed(nodes):
        c, t = node.chars, max(node.tags, 1)
        if c:
            lc, lt = max(node.link_chars, 1), max(node.link_tags + (node.tag == "a"), 1)
            base = math.log(c * node.link_chars / max(c - node.link_chars, 1) + share * c + math.e)
            node.density = c / t * math.log(max(c * t / (lc * lt), 1.0)) / (1 + math.log(base))
        node.total = sum(x.density for x in node.children if isinstance(x, Node)) or node.density


def main_node(body: Node) -> Node | None:
    """The element that holds the densest subtrees; none where the page has no text."""
    _count(_ordered(body))
    if not body.chars:
        return None
    nodes = _ordered(body)
    _score(nodes)
    best = max(nodes, key=lambda n: n.total)
    threshold, node = math.inf, best
    while node is not None:
        threshold = min(threshold, node.density)
        if node is body:
            break
        node = node.parent
    dense = [best]
    waiting = [body]
    while waiting:  # in each branch above the threshold, its element with the largest sum
        node = waiting.pop()
        for child in node.children:
            if isinstance(child, Node) and child.chars and child.density >= threshold:
                inner = max(_ordered(child), key=lambda n: n.total)
                dense.append(inner)
    return _common(dense, body)


def _common(nodes: list[Node], body: Node) -> Node:
    """The article or main element around the first node, else the lowest element that holds all nodes."""

    def path(node: Node) -> list[Node]:
        out = [node]
        while out[-1] is not body and out[-1].parent is not None:
            out.append(out[-1].parent)
        return out[::-1]

    best = path(nodes[0])
    for tag in ("article", "main"):
        if whole := next((n for n in best if n.tag == tag), None):
            return whole
    last = body
    for level in zip(best, *(path(n) for n in nodes[1:]), strict=False):
        if any(x is not level[0] for x in level):
            break
        last = level[0]
    return last


def text_of(node: Node) -> str:
    """Text of an element: white space inside a block is one space, blocks stand on lines of their own."""
    lines, line = [], []

    def end() -> None:
        text = SPACE.sub(" ", "".join(line)).strip()
        if text:
            lines.append(text)
        line.clear()

    stack: list[tuple[Node, int]] = [(node, 0)]
    while stack:
        at, k = stack.pop()
        if k == 0 and at.tag in BLOCK:
            end()
        while k < len(at.children):
            child = at.children[k]
            k += 1
            if isinstance(child, str):
                line.append(child)
            elif child.tag in VOID:
                if child.tag in BLOCK:
                    end()
                elif child.tag in ("br", "wbr"):
                    line.append(" " if child.tag == "br" else "")
            else:
                stack.append((at, k))
                stack.append((child, 0))
                break
        else:
            if at.tag in BLOCK:
                end()
    end()
    return "\n".join(lines)


def _precedes(title: Node, node: Node) -> bool:
    """Whether a page's only title stands before the main text and not in it."""
    while node.parent is not None:
        at, node = node, node.parent
        for child in node.children:
            if child is at:
                break
            if isinstance(child, Node) and any(n is title for n in _ordered(child)):
                return True
    return False


def main_text(html: str | None) -> str:
    """The article of a page; empty where there is none, or no page."""
    if not html or not html.strip():
        return ""
    body = parse(html)
    node = main_node(body)
    if node is None:
        return ""
    title = [n for n in _ordered(body) if n.tag == "h1" and n.chars]
    before = [text_of(title[0])] if len(title) == 1 and _precedes(title[0], node) else []
    return "\n".join([*before, text_of(node)])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars (code points).

    Null, empty and blank pages have the empty text; text without tags is its own article. Ids and urls are
    passed on as they are, repeated and null ones too; other columns are not read.
    """
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                some = batch.slice(lo, 500)
                texts = [main_text(h) for h in some.column(2).to_pylist()]
                yield pa.record_batch([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
