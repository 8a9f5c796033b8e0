"""Token spans of a text with preferred ends.

The tokenizer is an interface: ``spans(text)`` gives the (start, end) characters of each token. The default cuts words,
punctuation and white space without loss, so the text of a token span is a slice of the text. A model's tokenizer can be
given instead where its files are at hand.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .batches import parts

TARGET, OVERLAP, SEARCH_SHARE, LEAST_SEARCH, TAIL = 512, 64, 0.25, 32, 16
_TOKENS = re.compile(r"\s*\w+|\s*[^\w\s]|\s+$")
_SENTENCE_ENDS, _CLOSERS = (".", "!", "?"), "\"')]"
SPANS = "array<struct<chunk_index:int,token_start:int,token_end:int,overlap:int,text:string>>"


@dataclass(frozen=True)
class ChunkSettings:
    target: int = TARGET
    overlap: int = OVERLAP

    def __post_init__(self):
        if self.target <= 0 or not 0 <= self.overlap < self.target:
            raise ValueError("a chunk needs target > 0 and 0 <= overlap < target")

    @property
    def search(self) -> int:
        """P20: how far before the wished end a better one is looked for."""
        return min(max(LEAST_SEARCH, round(SEARCH_SHARE * self.target)), self.target - self.overlap - 1)


def regex_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKENS.finditer(text)]


def boundary_priority(tail: str) -> int:
    """4 after an empty line, 3 after a line, 2 after a sentence, 1 after white space, else 0."""
    lines = tail.rstrip(" \t")
    if lines.endswith("\n"):
        return 4 if lines[:-1].rstrip(" \t").endswith("\n") else 3
    words = tail.rstrip()
    if words.rstrip(_CLOSERS).endswith(_SENTENCE_ENDS):
        return 2
    return int(len(words) < len(tail))


def bpe_spans(path: str) -> Callable[[str], list[tuple[int, int]]]:
    """The token spans of a tokenizer file, as characters; the file is loaded once in each worker.

    Where a character takes several tokens, the first has it and the others are empty spans behind it, so texts of token spans
    stay slices of the text and meet without gap.
    """

    def spans(text: str) -> list[tuple[int, int]]:
        out, end = [], 0
        for lo, hi in _tokenizer(path).encode(text, add_special_tokens=False).offsets:
            out.append((max(lo, end), max(hi, end)))
            end = max(hi, end)
        return out

    return spans


@functools.cache
def _tokenizer(path: str):
    try:
        from tokenizers import Tokenizer
    except ImportError as e:
        raise RuntimeError("the tokenizers library is needed to cut by a tokenizer file") from e
    return Tokenizer.from_file(path)


def split_spans(text: str, settings: ChunkSettings, tokenize: Callable[[str], list[tuple[int, int]]] = regex_spans) -> list[tuple[int, int, int, str]]:
    """(token_start, token_end, overlap with the span before, text) of each chunk; empty text has none."""
    at = tokenize(text)
    total, start, before, out = len(at), 0, 0, []
    while total:
        end = _choose_end(text, at, start, total, settings)
        out.append((start, end, before - start if out else 0, text[at[start][0] : at[end - 1][1]]))
        if end >= total:
            break
        start, before = end - settings.overlap, end
    return out


def _choose_end(text: str, at: list[tuple[int, int]], start: int, total: int, settings: ChunkSettings) -> int:
    wished = start + settings.target
    if wished >= total:
        return total
    best, found = 0, wished
    for end in range(wished, max(start + settings.overlap + 1, wished - settings.search) - 1, -1):
        # White space leads the next token, so what stands before the next word belongs to the look at the end.
        lead = text[at[end][0] : at[end][1]]
        tail = text[at[max(start, end - TAIL)][0] : at[end - 1][1]] + lead[: len(lead) - len(lead.lstrip())]
        level = boundary_priority(tail)
        if level > best:
            best, found = level, end
        if best == 4:
            break
    return found


def chunks_of(text: Column, settings: ChunkSettings = ChunkSettings(), tokenize: Callable[[str], list[tuple[int, int]]] = regex_spans) -> Column:  # noqa: B008
    """The chunks of each text as an array, in batches of rows."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in (part for batch in batches for (part,) in parts(batch)):
            yield pd.Series([[{"chunk_index": i, "token_start": a, "token_end": b, "overlap": o, "text": t} for i, (a, b, o, t) in enumerate(split_spans(x or "", settings, tokenize))] for x in texts], dtype=object)

    return F.pandas_udf(run, SPANS)(text)
