"""The blocks of a page's main container, with inline markup as Markdown. Standard library only."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .batches import parts

#: Container order, the least text of a container, what is removed, and the heading that ends a page.
CONTAINERS = ("main", "article", "body")
MIN_CONTAINER_CHARS = 500
REMOVED = frozenset("script style noscript template nav header footer aside form button iframe svg".split())
STOP_HEADINGS = frozenset(["feedback"])
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEADINGS = {f"h{n}": n for n in range(1, 7)}
BLOCKS = "array<struct<block_index:int,type:string,level:int,ordered:boolean,language:string,text:string,rows:array<array<string>>,links:array<string>>>"
_CLOSE_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children:
            if isinstance(c, Node):
                yield from c.walk()

    def plain(self) -> str:
        return "".join(c if isinstance(c, str) else c.plain() for c in self.children)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.stack = [self.root]

    def _close(self, tag: str, bound: frozenset[str] = frozenset()) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                return
            if self.stack[k].tag in bound:
                return

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSE_P:
            self._close("p", frozenset(("td", "li", "div", "section", "article", "body")))
        if tag in ("li", "dt", "dd", "tr", "td", "th"):
            for other in {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}[tag]:
                self._close(other, frozenset(("ul", "ol", "dl", "table", "tr") if tag != "tr" else ("table",)))
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_endtag(self, tag):
        self._close(tag)

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def _strip(node: Node) -> None:
    node.children = [c for c in node.children if isinstance(c, str) or c.tag not in REMOVED]
    for c in node.children:
        if isinstance(c, Node):
            _strip(c)


def container(root: Node) -> Node:
    """The first container by preference with enough text, else the root."""
    for name in CONTAINERS:
        for n in root.walk():
            if (n.tag == name or n.attrs.get("role") == name) and len(_SPACE.sub(" ", n.plain()).strip()) >= MIN_CONTAINER_CHARS:
                return n
    return next((n for n in root.walk() if n.tag in CONTAINERS), root)


def inline(node: Node | str, base: str, links: list[str]) -> str:
    """Inline markup as Markdown; links are absolute."""
    if isinstance(node, str):
        return node
    if node.tag == "br":
        return "\n"
    inner = "".join(inline(c, base, links) for c in node.children)
    shown = _SPACE.sub(" ", inner).strip()
    if node.tag == "a" and shown:
        href = node.attrs.get("href", "")
        if href and not href.startswith(("#", "javascript:", "mailto:")):
            url = urljoin(base, href)
            links.append(url)
            return f"[{shown}]({url})"
    if node.tag in ("strong", "b") and shown:
        return f"**{shown}**"
    if node.tag in ("em", "i") and shown:
        return f"*{shown}*"
    if node.tag in ("code", "kbd") and shown:
        return f"`{shown}`"
    return inner


def _flat(node: Node, base: str, links: list[str]) -> str:
    return _SPACE.sub(" ", "".join(inline(c, base, links) for c in node.children)).strip()


def code_language(node: Node) -> str | None:
    for n in node.walk():
        for name in n.attrs.get("class", "").split():
            m = re.match(r"(?:language|lang|highlight)-([\w+#-]+)", name)
            if m:
                return m[1].lower()
    return None


def _list(node: Node, base: str, links: list[str], depth: int = 0) -> list[str]:
    out, n = [], 0
    for li in (c for c in node.children if isinstance(c, Node) and c.tag == "li"):
        n += 1
        own = Node("li", {})
        own.children = [c for c in li.children if isinstance(c, str) or c.tag not in ("ul", "ol")]
        mark = f"{n}." if node.tag == "ol" else "-"
        out.append("  " * depth + f"{mark} {_flat(own, base, links)}".rstrip())
        for c in li.children:
            if isinstance(c, Node) and c.tag in ("ul", "ol"):
                out += _list(c, base, links, depth + 1)
    return out


def _table(node: Node, base: str, links: list[str]) -> list[list[str]]:
    rows = [[_flat(c, base, links) for c in tr.children if isinstance(c, Node) and c.tag in ("td", "th")] for tr in node.walk() if tr.tag == "tr"]
    return [r for r in rows if r]


def html_blocks(html: str | None, url: str | None = None) -> list[dict]:
    """Ordered blocks; what follows a stop heading is left out, as are blocks equal to the one before."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    top = container(tree.root)
    _strip(top)
    out: list[dict] = []
    base = url or ""

    def put(kind: str, text: str, links: list[str], **more) -> None:
        if (text or kind == "separator") and not (out and (out[-1]["type"], out[-1]["text"]) == (kind, text)):
            out.append({"type": kind, "text": text, "level": None, "ordered": None, "language": None, "rows": None, "links": list(dict.fromkeys(links))} | more)

    def visit(node: Node) -> None:
        loose: list[Node | str] = []

        def flush() -> None:
            links: list[str] = []
            text = _SPACE.sub(" ", "".join(inline(c, base, links) for c in loose)).strip()
            loose.clear()
            put("paragraph", text, links)

        for c in node.children:
            if isinstance(c, str) or c.tag not in (*HEADINGS, "p", "pre", "ul", "ol", "table", "blockquote", "dl", "hr", "div", "section", "article", "main", "body", "html", "figure", "details", "center"):
                loose.append(c)
                continue
            flush()
            links: list[str] = []
            if c.tag in HEADINGS:
                put("heading", _flat(c, base, links), links, level=HEADINGS[c.tag])
            elif c.tag == "p":
                put("paragraph", _flat(c, base, links), links)
            elif c.tag == "pre":
                put("code", c.plain().strip("\n"), links, language=code_language(c))
            elif c.tag in ("ul", "ol"):
                put("list", "\n".join(_list(c, base, links)), links, ordered=c.tag == "ol")
            elif c.tag == "table":
                rows = _table(c, base, links)
                put("table", "\n".join(" | ".join(r) for r in rows), links, rows=rows)
            elif c.tag == "blockquote":
                put("blockquote", _flat(c, base, links), links)
            elif c.tag == "dl":
                put("definition_list", "\n".join(("  " if x.tag == "dd" else "") + _flat(x, base, links) for x in c.children if isinstance(x, Node) and x.tag in ("dt", "dd")), links)
            elif c.tag == "hr":
                put("separator", "", links)
            else:
                visit(c)
        flush()

    visit(top)
    stop = next((k for k, b in enumerate(out) if b["type"] == "heading" and b["text"].strip().lower() in STOP_HEADINGS), len(out))
    return [{"block_index": k} | b for k, b in enumerate(out[:stop])]


def blocks_of(html: Column, url: Column) -> Column:
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for pages, urls in (part for batch in batches for part in parts(*batch)):
            yield pd.Series([html_blocks(p, u) for p, u in zip(pages, urls, strict=True)], dtype=object)

    return F.pandas_udf(run, BLOCKS)(html, url)
