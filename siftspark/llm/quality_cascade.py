"""Quality rules as a short-circuit cascade.

Every rule is a predicate over lazily computed features of one text. On a random sample over the whole table each rule's
cost (seconds) and rejections are estimated by one task; the rule with the most rejections per second goes first, and each
next one is chosen by what it still rejects of the texts that the rules before it let pass. The verdict is the conjunction
of all rules and so does not depend on the order; ``rejected_by`` names the first rule in this order that rejected. A filter
stops at a text's first rejection; the report works out the base counts of every text, as they are part of its result.

A word is a run of other than the six ASCII white-space characters, in the counts and in all rules; a letter is what
Unicode says (``\\p{L}``, so neither digits nor superscripts).

Defined results: null or empty text has no words and fails ``too_few_words``; a text of any length is read whole;
repeated rows are judged one by one; an empty table gives no rows and keeps the written order of the rules; other
columns pass through untouched whatever their names.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ASCII_SPACE, ship_package

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Rows, on average, that the cost and selectivity estimates look at, and the seed that draws them; they never bound what is judged.
SAMPLE_ROWS, SAMPLE_SEED = 400, 17
_VERDICT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_LETTER = regex.compile(r"\p{L}")


class TextFeatures:
    """Counts of one text, each worked out when a rule first asks for it."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space alone

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, ASCII_SPACE))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(ASCII_SPACE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        grams = list(zip(*(w[i:] for i in range(WINDOW)), strict=False))
        if len(set(grams)) == len(grams):
            return 0
        seen, total, end = Counter(grams), 0, 0
        for i, g in enumerate(grams):
            if seen[g] > 1:
                total += i + WINDOW - max(i, end)
                end = i + WINDOW
        return total

    @cached_property
    def n_letter_words(self) -> int:
        return sum(1 for w in self.words if _ASCII_LETTER.search(w) or (not w.isascii() and _LETTER.search(w.decode("utf-8", "surrogatepass"))))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[TextFeatures], bool]
    base: bool = False


#: The production rules. The base rules come from the contract of the query; the others only reject what is plainly not prose.
RULES = (
    Rule("too_few_words", lambda f: f.n_words < 10, base=True),
    Rule("repeated_windows", lambda f: 100 * f.n_repeat_words > 20 * f.n_words, base=True),
    Rule("many_symbols", lambda f: 10 * f.n_symbols > 3 * f.n_words),
    Rule("word_length", lambda f: not 2 * f.n_words <= f.word_chars <= 15 * f.n_words),
    Rule("duplicate_lines", lambda f: f.n_dup_lines >= 3 and 10 * f.n_dup_lines > 3 * len(f.lines)),
    Rule("few_letter_words", lambda f: 2 * f.n_letter_words < f.n_words),
)


@dataclass(frozen=True)
class RuleEstimate:
    """``hits`` tells for each text of the sample whether the rule rejects it."""

    name: str
    seconds: float
    rejected: float
    hits: tuple[bool, ...] = ()

    @property
    def gain(self) -> float:
        return self.rejected / max(self.seconds, 1e-9)


def estimate(texts: list[str | None], rules: tuple[Rule, ...] = RULES) -> list[RuleEstimate]:
    """Seconds per text, features from scratch included, and rejections of each rule."""
    out = []
    for rule in rules:
        began = time.perf_counter()
        hits = tuple(rule.rejects(TextFeatures(t)) for t in texts)
        out.append(RuleEstimate(rule.name, (time.perf_counter() - began) / max(len(texts), 1), sum(hits) / max(len(texts), 1), hits))
    return out


def order_rules(estimates: list[RuleEstimate], rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """Most rejections per second first, each counted on what the rules before let pass; ties keep the written order."""
    left, passed, order = list(estimates), None, []
    while left:
        if all(e.hits for e in left):
            passed = passed or [True] * len(left[0].hits)
            now = [RuleEstimate(e.name, e.seconds, sum(h and p for h, p in zip(e.hits, passed, strict=True)) / len(passed)) for e in left]
        else:
            now = left
        k = max(range(len(left)), key=lambda i: (now[i].gain, -i))
        if passed:
            passed = [p and not h for p, h in zip(passed, left[k].hits, strict=True)]
        order.append(left.pop(k).name)
    return _by_name(order, rules)


def plan_cascade(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """The rules in their order. One task estimates; the driver gets the names alone."""
    texts = docs.select(F.col(text_col).alias("t"))
    share = min(1.0, sample_rows / max(texts.count(), 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = [t for pdf in batches for t in pdf["t"]]
        yield pd.DataFrame({"name": [r.name for r in order_rules(estimate(seen, rules), rules)]})

    # Twice the rows that a share yields on average: the limit is there for the estimating task's memory.
    drawn = texts.sample(share, SAMPLE_SEED).limit(2 * sample_rows).coalesce(1)
    names = [r.name for r in drawn.mapInPandas(run, "name string").collect()]
    return _by_name(names[: len(rules)], rules) if names else rules


def judge(text: str | None, ordered: tuple[Rule, ...]) -> tuple[TextFeatures, str | None]:
    """The features worked out on the way and the first rule that rejects, or None."""
    f = TextFeatures(text)
    return f, next((r.name for r in ordered if r.rejects(f)), None)


def _by_name(names: list[str], rules: tuple[Rule, ...]) -> tuple[Rule, ...]:
    at = {r.name: r for r in rules}
    return tuple(at[n] for n in names)


def _counts_udf(names: list[str]):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ordered = _by_name(names, RULES)
        base = [r for r in ordered if r.base]
        cols = [x.split()[0] for x in _VERDICT.split(", ")]
        for texts in batches:
            rows = []
            for t in texts:
                f, by = judge(t, ordered)
                failed = by is not None and any(r.rejects(f) for r in base)
                rows.append((f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, failed, by is None, by))
            yield pd.DataFrame(rows, columns=cols)

    return F.pandas_udf(run, _VERDICT)


def _kept_udf(names: list[str]):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ordered = _by_name(names, RULES)
        for texts in batches:
            yield pd.Series([judge(t, ordered)[1] is None for t in texts], dtype=bool)

    return F.pandas_udf(run, "boolean")


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, the base counts, and the verdict of the cascade. No shuffle."""
    ship_package(docs.sparkSession)
    names = [r.name for r in plan_cascade(docs, text_col)]
    return docs.select(F.col(id_col).alias("doc_id"), _counts_udf(names)(F.col(text_col)).alias("v")).select("doc_id", "v.*")


def quality_filter(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that every rule lets pass, with their own columns. No shuffle; each text stops at its first rejection."""
    ship_package(docs.sparkSession)
    return docs.where(_kept_udf([r.name for r in plan_cascade(docs, text_col)])(F.col(text_col)))
