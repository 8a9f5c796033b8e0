"""Text embeddings. The model is given; without model files a hashing embedder stands in (no claim on its quality)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSION = 64


def hashing_embedder(texts: list[str], dimension: int = DIMENSION) -> np.ndarray:
    """Signed word counts in hashed places, of length 1; text without words is the first axis."""
    out = np.zeros((len(texts), dimension))
    for i, t in enumerate(texts):
        for w in re.findall(r"\w+", (t or "").lower()):
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            out[i, h % dimension] += 1 if h >> 32 & 1 else -1
        if not out[i].any():
            out[i, 0] = 1
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def embed(text: Column, model: Callable[[list[str]], np.ndarray] = hashing_embedder) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(model(list(texts)).astype("float32"))) if len(texts) else pd.Series([], dtype=object)

    return F.pandas_udf(run, "array<float>")(text)
