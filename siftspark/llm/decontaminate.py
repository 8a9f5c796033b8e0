"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are normalised the same way: lower case, every run of other than letters and digits one space. An
item of m characters may differ from a passage by ``m // CHARS_PER_ERROR`` edits. It is cut into one piece more than that, so
any passage within the budget holds a piece unchanged. One Aho-Corasick automaton over all pieces finds the exact hits in
one pass of a text; each hit says where the item would lie, and Myers' bit-parallel distance settles it there. An item of
fewer than ``CHARS_PER_ERROR`` characters has no budget: it is one piece, found exactly, and only as whole words (so "a cat"
isn't found in "a catalogue").

The items are the stated query set. They go to the workers in blocks whose characters are counted as they are read and bounded
(``BLOCK_CHARS``, but for a longer item, which is a block of its own); a larger benchmark takes more passes over the
documents, and the results of each pass are written before the next. Documents are never shuffled.

Defined results: null or empty documents match nothing; null items and items without a letter or digit match nothing, all
others are searched however short; equal items are matched once and reported each; an item with a null id is reported with
a null item_id; repeated document rows are reported once a row; of several places the one with the least distance, then the
first, is reported; empty tables give no rows; extra columns are ignored (``decontaminate`` keeps those of the documents).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import durable, ship_package

CHARS_PER_ERROR = 16
#: Normalised characters of items that go to the workers at once.
BLOCK_CHARS = 4_000_000
_OTHER = re.compile(r"[\W_]+")
HITS = "doc_id long, item_id long, distance long, end long, item_chars long"


def normalise(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def error_budget(m: int) -> int:
    return m // CHARS_PER_ERROR


def cut(item: str) -> list[tuple[int, str]]:
    """(offset, piece) of error_budget + 1 pieces of even length."""
    m, n = len(item), error_budget(len(item)) + 1
    at = [i * m // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(at, at[1:], strict=False)]


def _whole_words(text: str, begin: int, end: int) -> bool:
    return text[begin - 1 : begin] in ("", " ") and text[end : end + 1] in ("", " ")


class Pattern:
    """Myers' bit-parallel distance of one item to the substrings of a text."""

    def __init__(self, item: str):
        self.m, self.item, self.budget = len(item), item, error_budget(len(item))
        self.masks: dict[str, int] = {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def search(self, text: str) -> tuple[int, int]:
        """(least distance, the first end where it is reached)."""
        full, high = (1 << self.m) - 1, 1 << (self.m - 1)
        up, down, score, best, end = full, 0, self.m, self.m, 0
        get = self.masks.get
        for j, c in enumerate(text):
            eq = get(c, 0)
            x = eq | down
            h = (((eq & up) + up) ^ up) | eq
            plus = down | (full & ~(h | up))
            minus = up & h
            if plus & high:
                score += 1
            elif minus & high:
                score -= 1
            plus, minus = plus << 1, minus << 1
            up = (minus | ~(x | plus)) & full
            down = plus & x & full
            if score < best:
                best, end = score, j + 1
        return best, end


class Matcher:
    """All items of one block: pieces in one automaton, and a pattern for each different item."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.ids: dict[str, list[int]] = {}
        for item_id, text in items:
            shown = normalise(text)
            if shown:
                self.ids.setdefault(shown, []).append(item_id)
        self.patterns = [Pattern(x) for x in self.ids]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, x in enumerate(self.ids):
            for offset, piece in cut(x):
                places.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, at in places.items():
            self.automaton.add_word(piece, (len(piece), at))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def hits(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, end, item length) of every item within its budget, best place first and only."""
        shown = normalise(text)
        if self.empty or not shown:
            return []
        starts: dict[int, set[int]] = {}
        for last, (length, at) in self.automaton.iter(shown):
            for k, offset in at:
                begin = last + 1 - length - offset
                if self.patterns[k].budget or _whole_words(shown, begin, last + 1):
                    starts.setdefault(k, set()).add(begin)
        out = []
        for k, begins in starts.items():
            p = self.patterns[k]
            best = None
            low = high = None
            windows = []
            for s in sorted(begins):
                if high is not None and s - p.budget <= high:
                    high = s + p.m + p.budget
                else:
                    if high is not None:
                        windows.append((low, high))
                    low, high = max(0, s - p.budget), s + p.m + p.budget
            windows.append((low, high))
            for low, high in windows:
                at = shown.find(p.item, low, high)
                d, end = (0, at + p.m - low) if at >= 0 else p.search(shown[low:high])
                if d <= p.budget and (best is None or (d, low + end) < best):
                    best = (d, low + end)
            if best:
                out += [(i, best[0], best[1], p.m) for i in self.ids[p.item]]
        return sorted(out, key=lambda h: (h[0] is not None, h))


_MATCHERS: dict[int, Matcher] = {}


def _matcher(items: list[tuple[int, str]]) -> Matcher:
    """The last block's matcher stays with the worker."""
    key = hash(tuple(items))
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(items)
    return _MATCHERS[key]


def _finder(items: list[tuple[int, str]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = _matcher(items)
        for pdf in batches:
            rows = [(d, *h) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for h in m.hits(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "end", "item_chars"])

    return run


def _clean_udf(items: list[tuple[int, str]]):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = _matcher(items)
        for texts in batches:
            yield pd.Series([not m.hits(t) for t in texts], dtype=bool)

    return F.pandas_udf(run, "boolean")


def item_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most block_chars characters or one item, one block at a time on the driver."""
    own = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    block, held = [], 0
    for r in own.toLocalIterator():
        if block and held + len(r.t) > block_chars:
            yield block
            block, held = [], 0
        block.append((r.i, r.t))
        held += len(r.t)
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, distance, end (in the normalised text), item_chars."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found: list[DataFrame] = []
    for items in item_blocks(benchmark, item_col, item_text_col, block_chars):
        found[-1:] = [durable(x, "leaks") for x in found[-1:]]
        found.append(rows.mapInPandas(_finder(items), HITS))
    return reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], HITS)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents without any item, with their own columns."""
    ship_package(docs.sparkSession)
    for k, items in enumerate(item_blocks(benchmark, item_col, item_text_col, block_chars)):
        docs = (durable(docs, "clean") if k else docs).where(_clean_udf(items)(F.col(text_col)))
    return docs
