"""Batches of rows in parts, so that a Python worker never has the results of a whole batch in hand."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd

#: Characters of text after which a part ends; a longer text is a part of its own.
PART_CHARS = 500_000


def parts(*columns: pd.Series) -> Iterator[tuple[pd.Series, ...]]:
    """The rows of equally long columns in parts by the characters of the first; an empty batch is one empty part."""
    size, low = 0, 0
    for n, text in enumerate(columns[0]):
        size += len(text or "")
        if size >= PART_CHARS:
            yield tuple(c.iloc[low : n + 1] for c in columns)
            size, low = 0, n + 1
    if low < len(columns[0]) or not len(columns[0]):
        yield tuple(c.iloc[low:] for c in columns)
