"""Secret scans with one combined deterministic automaton.

All rules are parsed, joined in one nondeterministic automaton that may start anywhere, made deterministic by subset
construction over byte classes, and minimised by partition refinement. The result is one flat transition array. A text is
read once, byte by byte, for all rules together; an entry of the array also says when a rule has just stopped matching, so
the loop looks up one number a byte. At such an end, the rule's own reversed automaton runs backwards, not past the last
match of that rule, and gives the leftmost start. This is leftmost-longest matching without overlap for rules whose last
part is a repeated class (or that end in a fixed string), which all rules here are and ``compile_rules`` demands.

The tables depend on the rules alone (some hundred KB) and go to the workers with the function.

Defined results: null or empty text has no spans; texts of any length are read whole; positions are code points, end
exclusive; repeated rows are scanned one by one; null ids stay; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ship_package

_c = re._constants


@dataclass(frozen=True)
class Rule:
    """pattern: ASCII regular expression of literals, classes, groups, alternation and repeats. min_chars drops shorter
    matches afterwards, min_tail those whose last repeated class (``tail``) took fewer characters."""

    kind: str
    pattern: str
    ignore_case: bool = False
    min_chars: int = 0
    min_tail: int = 0
    tail: str = ""
    base: bool = False


_VALUE = "A-Za-z0-9+/_.=-"
#: The base rules of the contract, in its order, and what the method adds to them. A repeat {16,} stands for + where dropping
#: shorter matches afterwards gives the same.
RULES = (
    Rule("assign", rf"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[{_VALUE}]+""", ignore_case=True, min_tail=12, tail=_VALUE, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", min_chars=18, base=True),
    Rule("hex", r"[0-9a-f]{16,}", base=True),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]+", min_chars=24),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", min_chars=20),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE_KINDS = tuple(r.kind for r in RULES if r.base)


# -- parsing to a nondeterministic automaton over bytes -------------------------------------------------------------


@dataclass
class _Nfa:
    """Transitions by byte set and by nothing, states numbered from 0."""

    moves: list[list[tuple[frozenset[int], int]]] = field(default_factory=list)
    empty: list[list[int]] = field(default_factory=list)

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


def _cased(byte_set: frozenset[int], ignore_case: bool) -> frozenset[int]:
    if not ignore_case:
        return byte_set
    return byte_set | {b ^ 32 for b in byte_set if chr(b).isascii() and chr(b).isalpha()}


def _byte_set(items) -> frozenset[int]:
    out: set[int] = set()
    for op, arg in items:
        if op is _c.LITERAL:
            out.add(arg)
        elif op is _c.RANGE:
            out |= set(range(arg[0], arg[1] + 1))
        else:
            raise ValueError(f"not supported in a class: {op}")
    return frozenset(out)


def _build(nfa: _Nfa, tree, start: int, ignore_case: bool, backwards: bool) -> int:
    """Adds tree behind start (its mirror image if backwards) and returns the state after it."""
    at = start
    for op, arg in reversed(list(tree)) if backwards else list(tree):
        if op in (_c.LITERAL, _c.IN):
            own = frozenset([arg]) if op is _c.LITERAL else _byte_set(arg)
            if max(own) > 127:
                raise ValueError("rules are ASCII")
            to = nfa.state()
            nfa.moves[at].append((_cased(own, ignore_case), to))
            at = to
        elif op is _c.SUBPATTERN:
            at = _build(nfa, arg[-1], at, ignore_case, backwards)
        elif op is _c.BRANCH:
            to = nfa.state()
            for way in arg[1]:
                nfa.empty[_build(nfa, way, at_copy := nfa.state(), ignore_case, backwards)].append(to)
                nfa.empty[at].append(at_copy)
            at = to
        elif op is _c.MAX_REPEAT:
            low, high, own = arg
            for _ in range(low):
                at = _build(nfa, own, at, ignore_case, backwards)
            if high is _c.MAXREPEAT:
                loop = nfa.state()
                nfa.empty[at].append(loop)
                nfa.empty[_build(nfa, own, loop, ignore_case, backwards)].append(loop)
                at = loop
            else:
                to = nfa.state()
                for _ in range(high - low):
                    nfa.empty[at].append(to)
                    at = _build(nfa, own, at, ignore_case, backwards)
                nfa.empty[at].append(to)
                at = to
        else:
            raise ValueError(f"not supported: {op}")
    return at


# -- subset construction and minimisation -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Automaton:
    """next[state * classes + class_of[byte]] is the next state; accepts[state] is a bit for each rule. State 0 starts."""

    class_of: bytes
    classes: int
    next: tuple[int, ...]
    accepts: tuple[int, ...]


def _byte_classes(nfa: _Nfa) -> tuple[bytes, list[int]]:
    """Bytes that no transition tells apart share a class: the class of each byte, and one byte of each class."""
    sets = list({s for moves in nfa.moves for s, _ in moves})
    seen: dict[tuple, int] = {}
    class_of = bytes(seen.setdefault(tuple(b in s for s in sets), len(seen)) for b in range(256))
    return class_of, [class_of.index(k) for k in range(len(seen))]


def _determinise(nfa: _Nfa, start: int, ends: dict[int, int]) -> Automaton:
    class_of, shown = _byte_classes(nfa)
    first = nfa.closure([start])
    number, order, table = {first: 0}, [first], []
    for states in order:
        for b in shown:
            to = nfa.closure({t for s in states for own, t in nfa.moves[s] if b in own})
            if to not in number:
                number[to] = len(order)
                order.append(to)
            table.append(number[to])
    accepts = tuple(sum(1 << r for r in {ends[s] for s in states if s in ends}) for states in order)
    return Automaton(class_of, len(shown), tuple(table), accepts)


def minimise(a: Automaton) -> Automaton:
    """Partition refinement from equal acceptance until no state's transitions tell it from its block."""
    n, k = len(a.accepts), a.classes
    block = list(a.accepts)
    count = len(set(block))
    while True:
        seen: dict[tuple, int] = {}
        block = [seen.setdefault((block[s], *(block[t] for t in a.next[s * k : s * k + k])), len(seen)) for s in range(n)]
        if len(seen) == count:
            break
        count = len(seen)
    shown = {b: s for s, b in reversed(list(enumerate(block)))}
    return Automaton(a.class_of, k, tuple(block[t] for b in range(count) for t in a.next[shown[b] * k : shown[b] * k + k]), tuple(a.accepts[shown[b]] for b in range(count)))


@dataclass(frozen=True)
class Scanner:
    """step[at + class] is the offset of the next state's row; from ``marked`` on it is an entry that says a rule has just
    ended: its row repeats the state's own, and ended[row] has the rules."""

    rules: tuple[Rule, ...]
    class_of: bytes
    width: int
    step: array
    marked: int
    ended: dict[int, int]
    open_at: dict[int, int]
    reverse: tuple[Automaton, ...]


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Scanner:
    nfa, ends = _Nfa(), {}
    root = nfa.state()
    nfa.moves[root].append((frozenset(range(256)), root))
    reverse = []
    for k, rule in enumerate(rules):
        tree = re._parser.parse(rule.pattern)
        last = list(tree)[-1]
        if last[0] not in (_c.LITERAL, _c.MAX_REPEAT) or last[0] is _c.MAX_REPEAT and last[1][1] is not _c.MAXREPEAT:
            raise ValueError(f"{rule.kind}: a rule ends with a literal or an open repeat")
        head = nfa.state()
        nfa.empty[root].append(head)
        ends[_build(nfa, tree, head, rule.ignore_case, False)] = k
        own = _Nfa()
        begin = own.state()
        reverse.append(minimise(_determinise(own, begin, {_build(own, tree, begin, rule.ignore_case, True): 0})))
    a = minimise(_determinise(nfa, root, ends))
    k, n = a.classes, len(a.accepts)
    # A transition that leaves acceptance goes to a marked copy of its target, one for each set of rules that end.
    marks: dict[tuple[int, int], int] = {}
    rows = [list(a.next[s * k : s * k + k]) for s in range(n)]

    def entry(s: int, t: int) -> int:
        over = a.accepts[s] & ~a.accepts[t]
        return marks.setdefault((t, over), n + len(marks)) if over else t

    table = [[entry(s, t) for t in rows[s]] for s in range(n)]
    flat = [x for row in table for x in row]
    for t, _ in list(marks):
        flat += table[t]
    step = array("l", [x * k for x in flat])
    open_at = {s * k: a.accepts[s] for s in range(n) if a.accepts[s]} | {m * k: a.accepts[t] for (t, _), m in marks.items() if a.accepts[t]}
    return Scanner(rules, a.class_of, k, step, n * k, {m * k: over for (_, over), m in marks.items()}, open_at, tuple(reverse))


def _start_of(a: Automaton, data: bytes, end: int, low: int) -> int:
    """The leftmost start at or after low of a match that ends at end, or -1."""
    found, s = -1, 0
    dead = None
    for at in range(end - 1, low - 1, -1):
        t = a.next[s * a.classes + a.class_of[data[at]]]
        if t == s == dead:
            break
        dead = t if not a.accepts[t] and all(x == t for x in a.next[t * a.classes : (t + 1) * a.classes]) else None
        s = t
        if a.accepts[s]:
            found = at
    return found


def _tail(data: bytes, start: int, end: int, letters: str) -> int:
    """Characters of the value at the end of an assignment: all behind the sign, blanks and the quote."""
    m = re.match(rb"[A-Za-z_]+[\"']? *[:=] *[\"']?", data[start:end])
    return end - start - m.end() if m else 0


def scan_bytes(scanner: Scanner, data: bytes) -> list[tuple[int, int, int]]:
    """(rule, start, end) in bytes of all matches long enough."""
    step, marked, at = scanner.step, scanner.marked, 0
    ends: list[tuple[int, int]] = []
    note = ends.append
    for i, c in enumerate(data.translate(scanner.class_of)):
        at = step[at + c]
        if at >= marked:
            note((i, scanner.ended[at]))
    if over := scanner.open_at.get(at, 0):
        note((len(data), over))
    low = [0] * len(scanner.rules)
    out = []
    for end, over in ends:
        for k, rule in enumerate(scanner.rules):
            if over >> k & 1:
                start = _start_of(scanner.reverse[k], data, end, low[k])
                if start < 0:
                    continue
                low[k] = end
                if end - start >= rule.min_chars and (not rule.min_tail or _tail(data, start, end, rule.tail) >= rule.min_tail):
                    out.append((k, start, end))
    return out


def find_secrets(scanner: Scanner, text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then in the order of the rules."""
    if not text:
        return []
    data = text.encode("utf-8")
    found = sorted(scan_bytes(scanner, data), key=lambda x: (x[1], x[0]))
    if len(data) == len(text):
        return [(scanner.rules[k].kind, s, e) for k, s, e in found]
    out, at, chars = [], 0, 0
    for k, s, e in found:
        chars, at = chars + len(data[at:s].decode("utf-8")), s
        out.append((scanner.rules[k].kind, chars, chars + e - s))  # a match is ASCII
    return out


_SPANS = "array<struct<kind:string,start:int,end:int>>"


def _scan_udf(scanner: Scanner):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in find_secrets(scanner, t)] for t in texts], dtype=object)

    return F.pandas_udf(run, _SPANS)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and all spans (kind, start, end). No shuffle."""
    ship_package(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), _scan_udf(compile_rules(rules))(F.col(text_col)).alias("spans"))


def secret_report(spans: DataFrame) -> DataFrame:
    joined = lambda own: F.array_join(F.transform(own, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
