"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased, every run of other than letters is one space, and characters are modelled up to ``ORDER`` long. For
each language the highest order counts occurrences, lower orders count the different characters in front of an n-gram,
each order has its own absolute discount, and the mass it frees goes to the next shorter context, down to the uniform
distribution. All n-grams that any language has seen lie in one sorted array of 64-bit hashes per order, beside them the log
probabilities of all languages, and the contexts likewise with their back-off weights. A text is looked up position by
position with binary search, longest context first, for all languages at once.

The language with the lowest cross-entropy per character wins. ``score`` is its share among all languages, tempered by the
square root of the length. A fold of the sample that is not counted calibrates rejection: for each language, the
``QUANTILE`` of its texts' excess cross-entropy, scaled by the square root of length, bounds what is accepted.

The models learn from a bounded sample: of each language at most ``ROWS_PER_LANGUAGE`` labelled rows of at most ``SAMPLE_CHARS``
characters each, those with the least hashes of doc_id; of more than ``LANGUAGES`` labels the most frequent are learned. Every text is predicted whole, long ones slice by slice, without a shuffle.

Defined results: null text and text without a letter are ``und`` with score 0; null labels and null ids are not learned from;
with nothing to learn from all are ``und``; ties go to the first language by name; repeated rows are predicted one by one; an
empty table gives no rows; extra columns are ignored. ``lang`` is ``und`` also where the text is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import ship_package, worker_cache

ORDER, LANGUAGES, ROWS_PER_LANGUAGE, SAMPLE_CHARS, QUANTILE = 4, 256, 400, 50_000, 0.999
UNKNOWN = "und"
#: Characters that are looked up together; it bounds the worker's arrays. Longer texts are cut, behind a space if one is near.
_CHUNK, _NEAR = 400_000, 1000
_PRIME = np.uint64(0x100000001B3)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GAP, _DRAW = 0, 1 << 40


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _collapsed(text: str) -> np.ndarray:
    """Code points with every run of other than letters as one space; zeros are gaps and stay."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = worker_cache("letters", _letters)[raw]
    gap = raw == _GAP
    space = ~letter & ~gap
    keep = ~space
    keep[:1] = True
    keep[1:] |= space[1:] & ~space[:-1]
    return np.where(letter | gap, raw, 32)[keep].astype(np.uint64)


def _shown(text: str) -> str:
    return text.replace("\x00", " ").lower()


def codes(texts: list[str]) -> np.ndarray:
    """Code points of the normalised texts, each text behind a gap and between two spaces."""
    return _collapsed("".join(f"\x00 {_shown(t)} " for t in texts))


def ngram_keys(c: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n characters that end at each position from n - 1 on."""
    key = np.full(len(c) - n + 1, n, np.uint64)
    for k in range(n):
        key = (key * _PRIME + c[k : len(c) - n + 1 + k]) * _M1
        key ^= key >> np.uint64(29)
    return key * _M2


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted key in the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class Models:
    """Per order n (from 1): grams[n] sorted with logp[n] (n-grams x languages); contexts[n] sorted with backoff[n]."""

    languages: list[str]
    grams: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: float
    mean: np.ndarray
    limit: np.ndarray

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) nats a character, and the characters of each text."""
        c = codes(texts)
        gap, total = c == _GAP, self._logp(c)
        begins = np.flatnonzero(gap)
        sums = np.add.reduceat(total.astype(np.float64), begins, axis=0)
        chars = np.add.reduceat((~gap).astype(np.int64), begins)
        return -sums / np.maximum(chars, 1)[:, None], chars

    def long_entropy(self, text: str, chunk: int = _CHUNK) -> tuple[np.ndarray, int]:
        """The same for one text of any length, slice by slice; each slice sees the characters before it."""
        sums, chars, at = np.zeros(len(self.languages)), 0, 0
        before = np.array([_GAP], np.uint64)
        while at < len(text):
            end = len(text) if at + chunk >= len(text) else text.rfind(" ", at + chunk - min(_NEAR, chunk // 2), at + chunk) + 1 or at + chunk
            own = _collapsed(" " * (at == 0) + _shown(text[at:end]) + " " * (end == len(text)))
            own = own[1:] if before[-1] == 32 and own[0] == 32 else own
            c = np.concatenate([before, own])
            sums += self._logp(c)[len(before) :].sum(axis=0, dtype=np.float64)
            chars, before, at = chars + len(own), c[-max(1, len(self.grams) - 1) :], end
        return -sums / max(chars, 1), chars

    def _logp(self, c: np.ndarray) -> np.ndarray:
        """(characters x languages): the log probability of each character after those before it; 0 for gaps."""
        n_lang, gap = len(self.languages), c == _GAP
        total = np.zeros((len(c), n_lang), np.float32)
        todo = np.flatnonzero(~gap)
        for n in range(len(self.grams), 0, -1):
            if n > 1:
                own = todo[todo >= n - 1]
            else:
                own = todo
            if not len(own):
                continue
            keys = ngram_keys(c, n)
            at = _find(self.grams[n - 1], keys[own - n + 1])
            hit = at >= 0
            total[own[hit]] += self.logp[n - 1][at[hit]]
            miss = own[~hit]
            if n > 1 and len(miss):
                ctx = _find(self.contexts[n - 1], ngram_keys(c, n - 1)[miss - n + 1])
                has = ctx >= 0
                total[miss[has]] += self.backoff[n - 1][ctx[has]]
            elif n == 1:
                total[miss] += self.floor + self.backoff[0][0]
            todo = np.concatenate([todo[todo < n - 1], miss]) if n > 1 else miss
        return total


def _table(c: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, counts, one end position of each) of the n-grams of c that hold no gap."""
    if len(c) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    clean = np.ones(len(c) - n + 1, bool)
    for k in range(n):
        clean &= c[k : len(c) - n + 1 + k] != _GAP
    ends = np.flatnonzero(clean) + n - 1
    keys, first, counts = np.unique(ngram_keys(c, n)[clean], return_index=True, return_counts=True)
    return keys, counts, ends[first]


def train(samples: dict[str, list[str]], order: int = ORDER) -> Models:
    """Kneser-Ney models of all languages over the union of their n-grams; every fifth text calibrates."""
    languages = sorted(k for k, v in samples.items() if v)
    counted = {k: codes([t for i, t in enumerate(samples[k]) if i % 5 or len(samples[k]) < 5]) for k in languages}
    n_lang = len(languages)
    tables = {k: [_table(counted[k], n) for n in range(1, order + 1)] for k in languages}
    alphabet = len(np.unique(np.concatenate([tables[k][0][0] for k in languages]))) + 1
    floor = -float(np.log(alphabet))
    grams, logp, contexts, backoff = [], [], [], []
    below = None
    for n in range(1, order + 1):
        # Where each n-gram of the union stands in some language's text, to name its context and its suffix.
        union_keys = np.unique(np.concatenate([tables[k][n - 1][0] for k in languages]))
        context_key = np.zeros(len(union_keys), np.uint64)
        suffix_key = np.zeros(len(union_keys), np.uint64)
        for k in languages:
            keys, _, ends = tables[k][n - 1]
            at = np.searchsorted(union_keys, keys)
            if n > 1 and len(keys):
                shorter = ngram_keys(counted[k], n - 1)
                context_key[at], suffix_key[at] = shorter[ends - n + 1], shorter[ends - n + 2]
        all_contexts, context_at = np.unique(context_key, return_inverse=True)
        lower = np.full((len(union_keys), n_lang), np.exp(floor)) if n == 1 else below[np.searchsorted(grams[-1], suffix_key)]
        p = np.zeros((len(union_keys), n_lang))
        weights = np.zeros((len(all_contexts), n_lang), np.float32)
        for j, k in enumerate(languages):
            keys, counts, ends = tables[k][n - 1]
            own = np.zeros(len(union_keys))
            if n == order:
                own[np.searchsorted(union_keys, keys)] = counts
            elif len(tables[k][n][0]):
                # Continuation count: in how many longer n-grams it is the suffix.
                longer_ends = tables[k][n][2]
                found, times = np.unique(ngram_keys(counted[k], n)[longer_ends - n + 1], return_counts=True)
                own[np.searchsorted(union_keys, found)] = times
            n1, n2 = (own == 1).sum(), (own == 2).sum()
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            sums = np.bincount(context_at, own, len(all_contexts))
            kinds = np.bincount(context_at, own > 0, len(all_contexts))
            seen = sums > 0
            free = np.where(seen, discount * kinds / np.maximum(sums, 1), 1.0)
            p[:, j] = np.maximum(own - discount, 0) / np.maximum(sums, 1)[context_at] + free[context_at] * lower[:, j]
            weights[:, j] = np.log(free)
        grams.append(union_keys)
        below = p
        logp.append(np.log(p).astype(np.float32))
        contexts.append(all_contexts if n > 1 else np.empty(0, np.uint64))
        backoff.append(weights)
    out = Models(languages, grams, logp, contexts, backoff, floor, np.zeros(n_lang), np.full(n_lang, np.inf))
    for j, k in enumerate(languages):
        held = [t for i, t in enumerate(samples[k]) if not i % 5] or samples[k]
        h, chars = out.entropies(held)
        out.mean[j] = np.median(h[:, j])
        out.limit[j] = np.quantile((h[:, j] - out.mean[j]) * np.sqrt(chars), QUANTILE)
    return out


def predict(models: Models | None, texts: list[str | None]) -> pd.DataFrame:
    """lang_best, score, cross_entropy, rejected of each text."""
    n = len(texts)
    best, score, entropy, rejected = [UNKNOWN] * n, np.zeros(n), np.full(n, np.nan), np.ones(n, bool)
    if models is not None:
        asked = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        at = 0
        while at < len(asked):
            group, held = [], 0
            while at < len(asked) and (not group or held + len(texts[asked[at]]) <= _CHUNK):
                group.append(asked[at])
                held += len(texts[asked[at]])
                at += 1
            if held <= _CHUNK:
                h, chars = models.entropies([texts[i] for i in group])
            else:
                h, chars = (np.array([x]) for x in models.long_entropy(texts[group[0]]))
            win = h.argmin(axis=1)
            low = h[np.arange(len(group)), win]
            share = 1 / np.exp(-(h - low[:, None]) * np.sqrt(chars)[:, None]).sum(axis=1)
            for k, i in enumerate(group):
                best[i] = models.languages[win[k]]
            score[group], entropy[group] = share, low
            rejected[group] = (low - models.mean[win]) * np.sqrt(chars) > models.limit[win]
    return pd.DataFrame({"lang_best": best, "score": score, "cross_entropy": entropy, "rejected": rejected})


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32 of the id as text, mod 5, is 0. A null id is in it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS_PER_LANGUAGE, order: int = ORDER) -> Models | None:
    """Models from the sample. Labels are counted first, so that only rows with low hashes, some more than are taken, are ranked."""
    labelled = docs.select(F.pmod(F.xxhash64(F.col(id_col)), F.lit(_DRAW)).alias("h"), F.col(id_col).alias("i"), F.col(lang_col).alias("l"), F.col(text_col).alias("t")).where(F.col("l").isNotNull() & ~held_out(F.col("i")))
    counts = labelled.groupBy("l").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "l").limit(LANGUAGES)
    # Three times the share that yields ``rows`` on average; small languages are taken whole.
    low = labelled.join(F.broadcast(counts), "l").where(F.col("h") / _DRAW < 3 * rows / F.col("c"))
    usable = low.where(F.col("t").isNotNull() & (F.length("t") <= SAMPLE_CHARS))
    rank = F.row_number().over(Window.partitionBy("l").orderBy("h", "i", "t"))
    samples: dict[str, list[str]] = {}
    for r in usable.withColumn("r", rank).where(F.col("r") <= rows).orderBy("l", "r").select("l", "t").collect():
        samples.setdefault(r.l, []).append(r.t)
    samples = {k: v for k, v in samples.items() if any(any(map(str.isalpha, t)) for t in v)}
    return train(samples, order) if samples else None


_COLUMNS = "lang_best string, score double, cross_entropy double, rejected boolean"


def _predict_udf(models: Models | None):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield predict(models, list(texts))

    return F.pandas_udf(run, _COLUMNS)


def identify(docs: DataFrame, models: Models | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang (und if rejected), lang_best, score, cross_entropy, rejected."""
    ship_package(docs.sparkSession)
    out = docs.select(F.col(id_col).alias("doc_id"), _predict_udf(models)(F.col(text_col)).alias("p")).select("doc_id", "p.*")
    return out.withColumn("lang", F.when(F.col("rejected"), UNKNOWN).otherwise(F.col("lang_best")))


def language_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    out = identify(docs, learn(docs, id_col, text_col, lang_col), id_col, text_col)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("lang_best").alias("lang_pred"), "score", "rejected", F.nanvl("cross_entropy", F.lit(None).cast("double")).alias("cross_entropy"))
