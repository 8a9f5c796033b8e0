"""Main text of web pages by wrapper induction.

A page becomes a small DOM tree: block elements are nodes named by tag and class, inline markup belongs to the text around
it, and repeated siblings (paragraphs, list items) share one node, as a wrapper's lists do. For each host the most frequent
tree is the wrapper's frame. Every other tree of the host is aligned with it by simple tree matching, which gives each
node a slot. Pages with the same tree and content count as one. A content that a slot has on nearly every page that has the
slot, and on nearly every page of the host, is constant: template, and left out where a page has that very content in that
slot. All else is content. Where elements say what they are, that is heeded as well: menus, sidebars, footers, notices, forms,
scripts, comments and adverts are no content although they vary, and an article or main element bounds it. Only a
whole word of class, id, role or itemprop says so, and never of html, body, main, article or what holds a main or article
element; so comments that are article elements themselves stay in. Weaker words (related, share, tags, search and so on) say
so outside an article; inside one the wrapper decides, and they count only where the host has too few pages for one.

Statistics are grouped by host, slot and content hash before anything is gathered by host, so a host with a third of all
pages is spread over all tasks; the frames and constant slots of the hosts are one small row each. Pages are parsed twice
(statistics, text) and their html moves only if the hosts' rows are too many to broadcast, and then not for hosts with many pages.

Defined results: null or empty html gives an empty text; broken markup is read as browsers do in the main (open elements end
with their parent, a comment without end takes the rest); a page whose slots are all constant keeps its article; a host with
fewer than ``MIN_PAGES`` different pages, and a url without a host, has no constant slots; repeated rows give repeated results; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import durable, named, numbered, ship_package, spread_join

MIN_PAGES = 4
#: The share of the pages with a slot, and of all pages of the host, that constant content is on.
CONSTANT_SHARE, HOST_SHARE = 0.9, 0.8
#: The hosts' wrappers are broadcast up to so many characters; beyond, pages meet them by host, hot hosts apart.
BROADCAST_CHARS = 8_000_000
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_NAMING = frozenset("class id role itemprop".split())
_WORD = re.compile(r"[a-z]+")
# The HTML vocabulary.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style template textarea title xmp".split())
#: Inline elements without content; they end with their parent.
CONTROLS = frozenset("button select svg".split())
NO_CONTENT = frozenset("aside dialog fieldset footer form head menu nav".split())
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table tbody thead tfoot"), "td": ("td th", "tr"), "th": ("td th", "tr"), "tbody": ("tbody thead tr td th", "table"), "tfoot": ("tbody thead tr td th", "table")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
#: Whole words of class, id, role or itemprop that say an element is a menu, sidebar, footer, notice, advert, form or comment.
NO_CONTENT_WORDS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising comment comments commentlist consent cookie cookies disqus footer form gdpr menu menubar modal nav navbar navigation navlinks newsletter notice notification popup promo promoted promotion replies reply respond sidebar sidenav signup sponsor sponsored subscribe subscription".split()
)
#: Words that say so outside an article, and in one only where the host has too few pages for its wrapper to tell.
WEAK_WORDS = frozenset(
    "alert banner breadcrumb breadcrumbs byline copyright disclaimer hidden login masthead pager pagination recommended related search share sharing skip skiplink social tagcloud tags toolbar topbar widget widgets".split()
)
_HEADER_WORDS = frozenset(["header"])
MAIN_WORDS = frozenset(["article", "main"])
_MAIN_NAMES = frozenset("main main-content main_content articlebody".split())
#: Elements that no name switches off.
_KEPT = MAIN_WORDS | {"html", "body"}


def _names(attributes: str) -> frozenset[str]:
    """The words of the attributes that name an element; of an attribute given twice the first counts."""
    named: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(attributes):
        if (name := name.lower()) in _NAMING:
            named.setdefault(name, "".join(values))
    return frozenset(" ".join(named.values()).lower().split())


class Page:
    """The collapsed tree of one page. Nodes are numbered in the order in which they first open."""

    def __init__(self, text: str | None):
        self.labels, self.parent, self.children, self.off, self.main = ["#root"], [-1], [[]], [False], [False]
        self.named, self.hinted, self.weak, self.holds = [False], [False], [False], [False]
        self.segments: list[tuple[int, str]] = []
        self._read(text or "")
        for k in range(len(self.labels) - 1, 0, -1):
            if self.holds[k]:
                self.holds[self.parent[k]] = True
        for k in range(1, len(self.labels)):
            self.off[k] |= self.off[self.parent[k]] or (self.named[k] and not self.holds[k])
            self.weak[k] = self.weak[self.parent[k]] or (self.hinted[k] and not self.holds[k])

    def _node(self, parent: int, tag: str, names: frozenset[str], again: bool) -> tuple[int, bool]:
        """The node for an element, and whether it stood there before."""
        inside = self.main[parent]
        hinted, main = bool(names & WEAK_WORDS), bool(names & _MAIN_NAMES)
        no_content = bool(names & NO_CONTENT_WORDS) or (hinted and not inside)
        label = ".".join([tag, *sorted(set(_WORD.findall(" ".join(names))))]) + "!" * no_content + "*" * main
        own = self.children[parent]
        for k in own if again else own[-1:]:
            if self.labels[k] == label:
                return k, True
        k = len(self.labels)
        self.labels.append(label)
        self.parent.append(parent)
        self.children.append([])
        own.append(k)
        self.main.append(inside or tag in MAIN_WORDS or main)
        self.named.append(tag not in _KEPT and (no_content or (not inside and bool(names & _HEADER_WORDS))))
        self.hinted.append(tag not in _KEPT and hinted and inside)
        self.weak.append(False)
        self.holds.append(tag in MAIN_WORDS)
        self.off.append(tag in NO_CONTENT or tag in CONTROLS or (not inside and tag == "header"))
        return k, False

    def _read(self, text: str) -> None:
        stack: list[tuple[str, int, bool]] = [("#root", 0, False)]
        # How many elements of each tag are open, so that nothing looks through a deep stack in vain.
        opened: Counter[str] = Counter()

        def close(depth: int) -> None:
            opened.subtract(t for t, _, _ in stack[depth:])
            del stack[depth:]

        put = self.segments.append
        at = 0
        for m in iter(_TOKEN.scanner(text).search, None):
            if m.start() < at:
                continue
            if m.start() > at:
                put((stack[-1][1], text[at : m.start()]))
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                if tag in BLOCKS or tag == "object":
                    put((-1, " "))
                for depth in range(len(stack) - 1, 0, -1) if opened[tag] > 0 else ():
                    if stack[depth][0] == tag:
                        close(depth)
                        break
                    if tag not in BLOCKS and tag not in CONTROLS and stack[depth][0] in BLOCKS:
                        break
                continue
            if tag in RAW:
                if not m[3].endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}(?:[\s/>]|\Z)", re.I).search(text, at)
                    shut = text.find(">", end.start()) if end else -1
                    at = shut + 1 if shut >= 0 else len(text)
                put((-1, " ") if tag in ("iframe", "noscript", "textarea") else (-1, ""))
                continue
            if tag in VOID:
                if tag in ("br", "hr"):
                    put((-1, " "))
                continue
            block = tag in BLOCKS
            if tag == "object":
                put((-1, " "))
            if tag in CONTROLS and m[3].endswith("/"):
                continue
            names = _names(m[3]) if m[3] else frozenset()
            if not block and tag not in CONTROLS and not names & (NO_CONTENT_WORDS | WEAK_WORDS):
                continue
            if block:
                put((-1, " "))
                if opened["p"] > 0:
                    for depth in range(len(stack) - 1, 0, -1):
                        if stack[depth][0] == "p":
                            close(depth)
                            break
                        if stack[depth][0] in CONTROLS or stack[depth][0] in BLOCKS and not (len(stack[depth][0]) == 2 and stack[depth][0][0] == "h"):
                            break
                if tag in CLOSES:
                    ends, bounds = CLOSES[tag]
                    for depth in range(len(stack) - 1, 0, -1) if any(opened[t] > 0 for t in ends) else ():
                        if stack[depth][0] in bounds or stack[depth][0] in CONTROLS:
                            break
                        if stack[depth][0] in ends:
                            close(depth)
                            break
            _, parent, again = stack[-1]
            k, was = self._node(parent, tag, names, again)
            stack.append((tag, k, was))
            opened[tag] += 1
        if at < len(text):
            put((stack[-1][1], text[at:]))

    def skeleton(self) -> str:
        """The tree in preorder, a line a node: depth and label."""
        depth = [0] * len(self.labels)
        for k in range(1, len(depth)):
            depth[k] = depth[self.parent[k]] + 1
        return "\n".join([f"{depth[k]} {self.labels[k]}" for k in self.preorder()])

    def preorder(self) -> list[int]:
        out, todo = [], [0]
        while todo:
            k = todo.pop()
            out.append(k)
            todo += reversed(self.children[k])
        return out

    def hashes(self) -> list[int | None]:
        """The hash of each node's own text in preorder, None where it has none or is no content anyway."""
        own: list[list[str]] = [[] for _ in self.labels]
        for k, t in self.segments:
            if k >= 0 and not self.off[k]:
                own[k].append(t)
        shown = ["".join(x).strip() for x in own]
        return [xxhash.xxh3_64_intdigest(shown[k]) - (1 << 63) if shown[k] else None for k in self.preorder()]

    def text(self, constant: set[int], wrapped: bool = False) -> str:
        """The text without nodes that are no content, and without those in ``constant``. ``wrapped``: the host's wrapper is known, so
        weak words inside an article say nothing that it doesn't."""
        off = self.off if wrapped else [a or b for a, b in zip(self.off, self.weak, strict=True)]
        keep = [not o and k not in constant for k, o in enumerate(off)]
        for own in ([a and b for a, b in zip(keep, self.main, strict=True)], keep, [not o and m for o, m in zip(off, self.main, strict=True)], [not o for o in off]):
            out = "".join([t for k, t in self.segments if k < 0 or own[k]])
            if out := " ".join((html_lib.unescape(out) if "&" in out else out).split()):
                return out
        return ""


# -- simple tree matching -----------------------------------------------------------------------------------------------


def read_skeleton(skeleton: str) -> tuple[list[str], list[list[int]]]:
    """Labels in preorder, and the children of each node."""
    labels: list[str] = []
    children: list[list[int]] = []
    stack: list[int] = []
    for k, line in enumerate(skeleton.split("\n")):
        depth, label = line.split(" ", 1)
        labels.append(label)
        children.append([])
        del stack[int(depth) :]
        if stack:
            children[stack[-1]].append(k)
        stack.append(k)
    return labels, children


def _tree_ids(labels: list[str], children: list[list[int]], known: dict[tuple, int]) -> list[int]:
    """A number for each node, equal where the subtrees are; children have larger indexes than their parents."""
    out = [0] * len(labels)
    for k in range(len(labels) - 1, -1, -1):
        out[k] = known.setdefault((labels[k], *[out[c] for c in children[k]]), len(known))
    return out


def tree_match(a: str, b: str) -> dict[int, int]:
    """Simple tree matching: the largest order-preserving map of nodes of a to nodes of b with equal labels and matched parents.

    Children that both sides begin or end with as equal subtrees are matched with each other at once, as no map of the rest
    can gain by another use of them. Nothing recurses, so the depth of a page doesn't matter.
    """
    la, ca = read_skeleton(a)
    lb, cb = read_skeleton(b)
    if la[0] != lb[0]:
        return {}
    known: dict[tuple, int] = {}
    ta, tb = _tree_ids(la, ca, known), _tree_ids(lb, cb, known)
    size = [1] * len(la)
    for k in range(len(la) - 1, -1, -1):
        size[k] += sum(size[c] for c in ca[k])
    plans: dict[tuple[int, int], tuple[int, int, list[int], list[int]]] = {}
    tables: dict[tuple[int, int], list[array]] = {}
    weights: dict[tuple[int, int], int] = {}

    def plan(i: int, j: int) -> tuple[int, int, list[int], list[int]]:
        """How many children are equal from the front and from the back, and those between of either side."""
        x, y = ca[i], cb[j]
        least = min(len(x), len(y))
        front = next((k for k in range(least) if ta[x[k]] != tb[y[k]]), least)
        back = next((k for k in range(least - front) if ta[x[-1 - k]] != tb[y[-1 - k]]), least - front)
        return front, back, x[front : len(x) - back], y[front : len(y) - back]

    # Pairs of nodes with equal labels, parents before children; weights are filled from the end.
    pairs, at = [(0, 0)], 0
    while at < len(pairs):
        i, j = pairs[at]
        at += 1
        if ta[i] == tb[j]:
            weights[i, j] = size[i]
            continue
        plans[i, j] = plan(i, j)
        _, _, x, y = plans[i, j]
        by_label: dict[str, list[int]] = {}
        for v in y:
            by_label.setdefault(lb[v], []).append(v)
        pairs += [(u, v) for u in x for v in by_label.get(la[u], ())]
    for i, j in reversed(pairs):
        if (i, j) in weights:
            continue
        front, back, x, y = plans[i, j]
        m = [array("i", bytes(4 * (len(y) + 1)))]
        for u in x:
            above, row = m[-1], array("i", [0])
            for q, v in enumerate(y):
                row.append(max(above[q + 1], row[q], above[q] + weights.get((u, v), 0)))
            m.append(row)
        tables[i, j] = m
        equal = ca[i][:front] + ca[i][len(ca[i]) - back :]
        weights[i, j] = 1 + m[-1][-1] + sum(size[u] for u in equal)

    out: dict[int, int] = {}
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        out[i] = j
        if (i, j) not in plans:  # equal subtrees
            todo += zip(ca[i], cb[j], strict=True)
            continue
        front, back, x, y = plans[i, j]
        todo += zip(ca[i][:front], cb[j][:front], strict=True)
        todo += zip(ca[i][len(ca[i]) - back :], cb[j][len(cb[j]) - back :], strict=True)
        m, p, q = tables[i, j], len(x), len(y)
        while p and q:
            if m[p][q] == m[p - 1][q]:
                p -= 1
            elif m[p][q] == m[p][q - 1]:
                q -= 1
            else:
                todo.append((x[p - 1], y[q - 1]))
                p, q = p - 1, q - 1
    return out


def slots(skeleton: str, frame: str) -> list[str]:
    """The slot of each node: its node of the frame, or the hash of its path where the frame has none, numbered where it repeats."""
    to = tree_match(skeleton, frame)
    labels, children = read_skeleton(skeleton)
    path = [""] * len(labels)
    for k, label in enumerate(labels):
        path[k] = xxhash.xxh3_64_hexdigest(f"{path[k]}/{label}")
        for c in children[k]:
            path[c] = path[k]
    seen: Counter[str] = Counter()
    out = []
    for k in range(len(labels)):
        if k in to:
            out.append(f"#{to[k]}")
        else:
            seen[path[k]] += 1
            out.append(path[k] if seen[path[k]] == 1 else f"{path[k]} {seen[path[k]]}")
    return out


# -- the distributed part ---------------------------------------------------------------------------------------------

_SEEN = pa.schema([("host", pa.string()), ("skeleton", pa.string()), ("hashes", pa.list_(pa.int64()))])


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part, rows = batch.slice(at, 1000), []
            for host, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                p = Page(text.as_py())
                rows.append((host, p.skeleton(), p.hashes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SEEN, strict=True)], schema=_SEEN)


def _align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf[["host", "skeleton"]].assign(slots=[slots(s, f) for s, f in zip(pdf["skeleton"], pdf["frame"], strict=True)])


def _extract(frames: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    known: dict[tuple[str, str], list[str]] = {}
    for texts, wrappers, constants in frames:
        out = []
        for text, frame, constant in zip(texts, wrappers, constants, strict=True):
            p = Page(text)
            drop: set[int] = set()
            if frame is not None and constant is not None and len(constant):
                key = (p.skeleton(), frame)
                if key not in known:
                    if len(known) > 5000:
                        known.clear()
                    known[key] = slots(*key)
                gone = set(constant)
                drop = {k for k, s, h in zip(p.preorder(), known[key], p.hashes(), strict=True) if f"{h} {s}" in gone}
            out.append(p.text(drop, frame is not None))
        yield pd.Series(out, dtype=object)


def host_of(url: Column) -> Column:
    """The host of a url in lower case, without user and port; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def induce_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, frame, constant): a row per host with MIN_PAGES different pages or more: its frame, and what is constant on its pages
    as content hash and slot (null if nothing is)."""
    ship_package(pages.sparkSession)
    seen = durable(pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).where(F.col("host").isNotNull()).mapInArrow(_survey, "host string, skeleton string, hashes array<long>").distinct(), "html-survey")
    forms = seen.groupBy("host", "skeleton").count()
    frames = durable(forms.groupBy("host").agg(F.max(F.struct("count", "skeleton")).alias("m"), F.sum("count").alias("host_pages")).select("host", F.col("m.skeleton").alias("frame"), "host_pages"), "html-frames")
    aligned = durable(forms.select("host", "skeleton").join(frames.select("host", "frame"), "host").mapInPandas(_align, "host string, skeleton string, slots array<string>"), "html-slots")
    cells = seen.select("host", "skeleton", F.posexplode("hashes").alias("pos", "hash")).where(F.col("hash").isNotNull()).groupBy("host", "skeleton", "pos", "hash").count()
    placed = cells.join(aligned.select("host", "skeleton", F.posexplode("slots").alias("pos", "slot")), ["host", "skeleton", "pos"])
    by_content = placed.groupBy("host", "slot", "hash").agg(F.sum("count").alias("n"))
    by_slot = by_content.groupBy("host", "slot").agg(F.sum("n").alias("pages"), F.max(F.struct("n", "hash")).alias("most"))
    common = by_slot.where((F.col("pages") >= MIN_PAGES) & (F.col("most.n") >= CONSTANT_SHARE * F.col("pages"))).join(frames.select("host", "host_pages"), "host")
    constant = common.where(F.col("most.n") >= HOST_SHARE * F.col("host_pages")).groupBy("host").agg(F.collect_list(F.concat_ws(" ", "most.hash", "slot")).alias("constant"))
    return durable(frames.where(F.col("host_pages") >= MIN_PAGES).select("host", "frame").join(constant, "host", "left"), "html-wrappers")


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """All columns of pages and __he_text, the main text (in place of a column of that name)."""
    pages = pages.drop("__he_text")
    wrappers = induce_wrappers(pages, url_col, html_col).toDF("__he_host", "__he_frame", "__he_constant")
    own = numbered(pages)
    url, html = (F.col(own.columns[pages.columns.index(c)]) for c in (url_col, html_col))
    hosted = own.withColumn("__he_host", host_of(url))
    size = wrappers.agg(F.sum(F.length("__he_frame") + F.length(F.concat_ws("", "__he_constant")))).first()[0] or 0
    hosted = hosted.join(F.broadcast(wrappers), "__he_host", "left") if size <= BROADCAST_CHARS else spread_join(hosted, wrappers, "__he_host", "left")
    extract = F.pandas_udf(_extract, "string")
    return hosted.select(*named(pages.columns), extract(html, "__he_frame", "__he_constant").alias("__he_text"))


def page_report(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    out = main_text(pages.select(id_col, url_col, html_col), url_col, html_col)
    return out.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col("__he_text").alias("text"), F.length("__he_text").cast("long").alias("n_chars"))
