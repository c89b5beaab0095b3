"""The main text of raw HTML by composite text density.

Each node's density is its characters per tag, adjusted by links: log to the base ln(C LC / NLC + C LCb / Cb + e) of
(C / LC)(T / LT), times C / T, where C and T are its characters and tags, LC and LT those of links, NLC = C - LC and b
the body; a base of up to e leaves the natural logarithm, as smaller ones know no bound. Densities count all nodes. The
node whose children's densities have the greatest sum is the main one, and the least density on its path to the body is
the threshold: siblings along that path that reach it belong to the text too. Where the path passes an article or main
element, the text is widened to it, and siblings count from there on.

Menus, headers, footers, sidebars, notices, adverts, forms and reader comments are neither the main node nor siblings of
the text and go from what is chosen: elements whose tag says so, or one whole class, id or role (not the id of a heading or
section, which is made from its words), unless they hold a first-level heading or the main element. A longer name
(`share-buttons`, `has-sidebar`, `side-effects`) says little: such an element goes from the chosen text if its density is
under half of that of the whole.

Tags follow the HTML rules: unquoted values may hold quotes, what has no end (a tag, comment, script) takes the rest of
the page. Text is joined as stated for the query: references decoded, white space within a block made one space, blocks
joined by a line feed. Edge cases: null or empty html, or no text, give an empty text; unclosed or misnested tags are
closed where the next block, list item or cell begins, or at the end; time is linear in the page, whatever is nested or
left open; every row gives one row, repeated rows included; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame

from damhwa.llm.common import map_batches

#: Elements without any text of the page, up to their end tags.
RAW = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in "script style noscript template iframe textarea svg object select".split()}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br-block caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul title".split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "title"}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: A start tag closes open elements of these names, up to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "body": ({"head"}, set()),
}
SCOPE = frozenset("article aside blockquote body div fieldset footer form header li main nav section table td th ul ol dl html figure".split())
BOILERPLATE = frozenset("nav footer aside form head button dialog menu".split())
KEEP_WHOLE = frozenset(("article", "main"))
NAMES = r"(?:ad|ads|adv|advert\w*|adbox|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|comments?|commentlist|disqus|respond|reply|replies|discussion|sidebar|side|aside|menu|nav|navbar|navigation|breadcrumbs?|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|footer|header|masthead|topbar|toolbar|pagination|pager|widget|complementary|contentinfo)"
WHOLE_NAME = re.compile(NAMES, re.I)
PART_NAME = re.compile(rf"(?:^|[_-]){NAMES}(?:$|[_-])", re.I)
DOUBT_SHARE = 0.5

_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_BETWEEN = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_UNQUOTED = re.compile(r"[^\s>]*")


class _Node:
    __slots__ = ("children", "chars", "doubt", "drop", "heart", "in_article", "link_chars", "link_tags", "names", "parent", "sure", "tag", "tags")

    def __init__(self, tag: str, parent: _Node | None, sure: bool = False, doubt: bool = False):
        self.tag, self.parent, self.sure, self.doubt = tag, parent, sure, doubt
        self.in_article = parent is not None and (parent.in_article or parent.tag in KEEP_WHOLE)
        self.heart = tag in ("h1", "main")
        self.drop = False
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.children: list = []  # nodes and strings
        self.names: Counter | None = Counter() if tag in SCOPE or parent is None else parent.names  # open elements of this scope


def _flags(tag: str, attributes: list[tuple[str, str]], in_article: bool) -> tuple[bool, bool]:
    """(the element is no part of a text, its density is to say so)."""
    if tag in BOILERPLATE:
        return True, False
    if tag == "header":
        return not in_article, False
    if tag in ("html", "body", "article", "main"):
        return False, False
    doubt = False
    tokens = [(kind, t) for kind, value in attributes for t in value.split()]
    section = tag == "section" or tag in HEADINGS or any(kind == "class" and t.lower() == "section" for kind, t in tokens)
    for kind, t in tokens:
        if in_article and (kind == "id" and section or t.lower() == "header" or tag == "p" and t.lower() in ("alert", "notice")):
            continue
        if WHOLE_NAME.fullmatch(t):
            return True, False
        doubt |= tag not in HEADINGS and PART_NAME.search(t) is not None and not (in_article and t.lower().endswith("header"))
    return False, doubt


def _attributes(html: str, at: int) -> tuple[list[tuple[str, str]], bool, int]:
    """(class, id and role, whether the tag closes itself, the place after its end); -1 if it has none."""
    found: list[tuple[str, str]] = []
    size = len(html)
    while True:
        after = _BETWEEN.match(html, at).end()
        if after >= size:
            return found, False, -1
        if html[after] == ">":
            return found, html[after - 1] == "/" and after > at, after + 1
        m = _ATTRIBUTE.match(html, after)
        name, at = m[0].lower(), m.end()
        m = _EQUALS.match(html, at)
        if m is None:
            continue
        at = m.end()
        if (quote := html[at : at + 1]) in ('"', "'") and quote:
            end = html.find(quote, at + 1)
            if end < 0:
                return found, False, -1
            value, at = html[at + 1 : end], end + 1
        else:
            m = _UNQUOTED.match(html, at)
            value, at = m[0], m.end()
        if name in ("class", "id", "role"):
            found.append((name, value))


class _Tree:
    """Elements as they are opened and closed; each step looks at no more than it closes, or one element."""

    def __init__(self):
        self.root = _Node("html", None)
        self.stack = [self.root]
        self.open: Counter = Counter()

    def text(self, s: str) -> None:
        self.stack[-1].children.append(s)

    def _pop_to(self, k: int) -> None:
        for node in self.stack[k:]:
            self.open[node.tag] -= 1
            scope = node.parent.names  # where it was counted
            scope[node.tag] -= 1
        del self.stack[k:]

    def _close_to(self, names, stop) -> None:
        if not any(self.open[n] for n in names):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[k].tag
            if tag in names:
                self._pop_to(k)
                return
            if tag in stop:
                return

    def _close_here(self, names) -> None:
        """As _close_to up to the nearest scope, which counts what is open in it."""
        here = self.stack[-1].names
        if any(here[n] for n in names):
            self._close_to(names, SCOPE)

    def start(self, tag: str, attributes: list[tuple[str, str]], closed: bool) -> None:
        if tag == "html":
            return
        if tag in CLOSES_P:
            self._close_here(("p",))
            if tag in HEADINGS:
                self._close_here(HEADINGS)
        if tag in CLOSES:
            self._close_to(*CLOSES[tag])
        top = self.stack[-1]
        node = _Node(tag, top, *_flags(tag, attributes, top.in_article or top.tag in KEEP_WHOLE))
        top.children.append(node)
        if tag not in VOID and not closed:
            self.stack.append(node)
            self.open[tag] += 1
            top.names[tag] += 1

    def end(self, tag: str) -> None:
        if tag in VOID or tag == "html" or not self.open[tag]:
            return
        if tag not in SCOPE and tag not in HEADINGS and not self.stack[-1].names[tag]:
            return  # it is open, if at all, outside this scope
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                self._pop_to(k)
                return


def parse(html: str) -> _Node:
    tree, at, size = _Tree(), 0, len(html)
    kept = 0  # text up to here has been taken
    while True:
        at = html.find("<", at)
        if at < 0 or at + 1 >= size:
            break
        c = html[at + 1]
        if c == "!" or c == "?":
            begin, close = (at + 4, "-->") if html.startswith("<!--", at) else (at + 2, ">")
            end = html.find(close, begin)
            tag_end = end + len(close) if end >= 0 else -1
            tag = None
        elif c == "/":
            m = _TAG_NAME.match(html, at + 2)
            end = html.find(">", at + 2)
            tag_end, tag = end + 1 if end >= 0 else -1, m[0].lower() if m else None
        else:
            m = _TAG_NAME.match(html, at + 1)
            if m is None:
                at += 1
                continue
            tag = m[0].lower()
            attributes, closed, tag_end = _attributes(html, m.end()) if html[m.end() : m.end() + 1] != ">" else ([], False, m.end() + 1)
        if at > kept:
            tree.text(html[kept:at])
        if tag_end < 0:
            return tree.root
        kept = at = tag_end
        if tag is None:
            continue
        if c == "/":
            tree.end(tag)
        elif tag in RAW:
            if not closed:
                m = RAW[tag].search(html, at)
                if m is None:
                    return tree.root
                kept = at = m.end()
        else:
            tree.start(tag, attributes, closed)
    if kept < size:
        tree.text(html[kept:])
    return tree.root


def _ordered(root: _Node) -> list[_Node]:
    """All nodes, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [c for c in reversed(node.children) if c.__class__ is _Node]
    return out


def _count(nodes: list[_Node]) -> None:
    """Fill in characters and tags, of links too, and what holds a first-level heading or the main element."""
    links = set()
    for node in nodes:
        in_link = node.tag == "a" or node.parent in links
        if in_link:
            links.add(node)
        chars = sum([len(c.strip()) for c in node.children if c.__class__ is str])
        node.chars, node.tags, node.link_chars, node.link_tags = chars, 1, chars * in_link, int(node.tag == "a")
    for node in reversed(nodes):
        if (up := node.parent) is not None:
            up.chars += node.chars
            up.tags += node.tags
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
            up.heart |= node.heart


def density(node: _Node, body_ratio: float) -> float:
    """body_ratio: the share of links in the body's characters."""
    c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, node.link_tags
    if not c:
        return 0.0
    base = log(c * lc / max(1, c - lc) + body_ratio * c + e)
    return c / t * log(max(1.0, c / max(1, lc) * t / max(1, lt))) / max(1.0, log(base))


def _blocks(chosen: list[_Node]) -> str:
    lines: list[str] = []
    words: list[str] = []

    def flush() -> None:
        if words:
            if line := " ".join(unescape("".join(words)).split()):
                lines.append(line)
            words.clear()

    for top in chosen:
        work: list = [top]
        flush()
        while work:
            x = work.pop()
            if x.__class__ is str:
                words.append(x)
            elif x is None:
                flush()
            elif not x.drop:
                if x.tag == "br":
                    words.append(" ")
                    continue
                if x.tag in BLOCK:
                    flush()
                    work.append(None)
                work += reversed(x.children)
        flush()
    return "\n".join(lines)


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root = parse(html)
    nodes = _ordered(root)
    _count(nodes)
    body = next((n for n in nodes if n.tag == "body"), root)
    ratio = body.link_chars / body.chars if body.chars else 0.0
    by = {id(n): density(n, ratio) for n in nodes}
    for node in nodes:
        node.drop = node.sure and not node.heart and node is not body or node.parent is not None and node.parent.drop
    best, most = body, -1.0
    for node in nodes:
        if not node.drop:
            total = sum([by[id(c)] for c in node.children if c.__class__ is _Node])
            if total > most:
                best, most = node, total
    path, node = [], best
    while node is not None and node is not body:
        path.append(node)
        node = node.parent
    if node is None:  # outside the body
        path, body = [best], best
    else:
        path.append(body)
    threshold = min(by[id(n)] for n in path)
    if whole := next((n for n in reversed(path) if n.tag in KEEP_WHOLE), None):
        path = path[path.index(whole) :]
    taken = {id(path[0])}
    for child, parent in zip(path, path[1:]):
        taken |= {id(c) for c in parent.children if c.__class__ is _Node and c is not child and not c.drop and not c.doubt and c.chars and by[id(c)] >= threshold}
    for node in nodes:
        node.drop |= node.doubt and by[id(node)] < DOUBT_SHARE * by[id(path[0])] and id(node) not in taken
    return _blocks([n for n in nodes if id(n) in taken])


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each page. A narrow map."""

    def start():
        def step(batch: pa.RecordBatch) -> dict:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            return {id_col: batch.column(0), url_col: batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

        return step

    src = df.select(id_col, url_col, html_col)
    kind = lambda k: src.schema[k].dataType.simpleString()
    return map_batches(src, f"`{id_col}` {kind(0)}, `{url_col}` {kind(1)}, text string, n_chars long", start)
