"""Verbatim spans of a source text that can be quoted."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .batches import parts

MAX_CHARS, MIN_CHARS, BREAK_SHARE = 450, 24, 0.55
SPANS = "array<struct<lo:int,hi:int,truncated:boolean,text:string>>"
_FENCE = re.compile(r"^(```|~~~).*?(?:^\1[^\n]*$|\Z)", re.S | re.M)
_PARAGRAPH = re.compile(r"[^\n](?:(?!\n[ \t]*\n).)*", re.S)
_SENTENCE = re.compile(r".+?(?:[.!?](?=\s)|\Z)", re.S)
_HEADING = re.compile(r"#{1,6}\s+[^\n]*\Z")


def _trim(text: str, lo: int, hi: int) -> tuple[int, int]:
    """The part of a span without white space at its ends."""
    own = text[lo:hi]
    return hi - len(own.lstrip()), lo + len(own.rstrip())


def _cut(text: str, lo: int, hi: int, limit: int) -> Iterator[tuple[int, int, bool]]:
    """A span in pieces of at most limit characters: whole sentences, or a cut at the last blank of the later part."""
    if hi - lo <= limit:
        yield lo, hi, False
        return
    for m in _SENTENCE.finditer(text, lo, hi):
        a, b = _trim(text, *m.span())
        if b - a <= limit:
            if a < b:
                yield a, b, False
            continue
        end = max(text.rfind(" ", a, a + limit), text.rfind("\n", a, a + limit))
        yield (a, end, True) if end >= a + limit * BREAK_SHARE else (a, a + limit, True)


def extract_spans(text: str | None, limit: int = MAX_CHARS) -> list[tuple[int, int, bool]]:
    """(lo, hi, truncated) of paragraphs and sentences outside fenced code; the first piece of text if none is long enough."""
    if not text or not text.strip():
        return []
    fences = [m.span() for m in _FENCE.finditer(text)]
    found, fallback = [], None
    for m in _PARAGRAPH.finditer(text):
        lo, hi = _trim(text, *m.span())
        if lo >= hi or any(a < hi and lo < b for a, b in fences):
            continue
        for a, b, cut in _cut(text, lo, hi, limit):
            fallback = fallback or (a, b, cut)
            if b - a >= MIN_CHARS and not _HEADING.match(text, a, b):
                found.append((a, b, cut))
    return found or ([fallback] if fallback else [])


def spans_of(text: Column, limit: int = MAX_CHARS) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in (part for batch in batches for (part,) in parts(batch)):
            yield pd.Series([[{"lo": a, "hi": b, "truncated": c, "text": t[a:b]} for a, b, c in extract_spans(t, limit)] for t in texts], dtype=object)

    return F.pandas_udf(run, SPANS)(text)
