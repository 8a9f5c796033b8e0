"""Scalar text and array expressions. All but ``nfc`` stay inside the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Token patterns, marker patterns and thresholds that results must agree on.
TOKEN = r"[A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)*"
WORD_COUNT = r"(?U)\b[\w.-]+\b"
MARKER = r"\[(C[1-9][0-9]*)\]"
HEADING_ONLY = r"\A#{1,6}\s+\S[^\n]*\z"
CHUNK_ID = r"\A(?<doc>[a-z0-9]+-[0-9]{3})-sec-(?<sec>[0-9]{3})-ch-(?<ch>[0-9]{3})\z"
SPACE = r"(?U)[\s\x1c-\x1f]+"
SHORT_TOKENS = 32
EVIDENCE_TOKEN = r"(?U)[A-Za-z][A-Za-z0-9_-]*|\d+"
STOP_WORDS = "a an the and or how what which who why where when is are was were be been being of for on in as at to from by with it its these those this that can could would should do does did you your our does not means into than through their them each all every using use used about without while if such set field fields kubernetes pod pods cluster".split()


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def tokens(text: Column) -> Column:
    """Lower-case terms with inner ``. _ / -``; duplicates stay. Null text has none."""
    t = F.coalesce(text, F.lit(""))
    # Terms are ASCII, so lower-casing A-Z before they are cut says the same as lower-casing each; lower() is the quick way where all is ASCII.
    small = F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, UPPER.lower()))
    return F.regexp_extract_all(small, F.lit(TOKEN), F.lit(0))


def lines_with_text(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.trim(x) != "")


def heading_only(text: Column) -> Column:
    """Exactly one line has text, and it is a Markdown heading."""
    lines = lines_with_text(text)
    return (F.size(lines) == 1) & F.coalesce(F.trim(F.get(lines, F.lit(0))).rlike(HEADING_ONLY), F.lit(False))


def quality_flags(text: Column, token_count: Column, short: int = SHORT_TOKENS) -> Column:
    """``heading_only`` and ``very_short``, in this order."""
    return F.array_compact(F.array(F.when(heading_only(text), F.lit("heading_only")), F.when(token_count < short, F.lit("very_short"))))


def indexable(text: Column, token_count: Column, short: int = SHORT_TOKENS) -> Column:
    """All but short headings without a body."""
    return ~(heading_only(text) & (token_count < short))


def normal_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def heading_path(path: Column) -> Column:
    """P5: white space collapsed, empty parts dropped."""
    return F.filter(F.transform(path, normal_space), lambda x: x != "")


def retrieval_text(path: Column, text: Column) -> Column:
    """The path, an empty line, the text."""
    return F.concat_ws("\n\n", F.nullif(F.array_join(heading_path(path), " > "), F.lit("")), F.trim(text))


def sha256_text(text: Column) -> Column:
    """P8."""
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def word_count(text: Column) -> Column:
    """P10: Unicode words with inner dots and dashes."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_COUNT))


def preview(text: Column, limit: int) -> Column:
    """One line of at most limit characters."""
    t = normal_space(text)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 1), F.lit("…"))).otherwise(t)


def section_id(doc: Column, n: Column) -> Column:
    """P12."""
    return F.format_string("%s-sec-%03d", doc, n)


def chunk_id(section: Column, n: Column) -> Column:
    return F.format_string("%s-ch-%03d", section, n)


def parse_chunk_id(value: Column) -> Column:
    """struct(document_id, section_id, section_number, chunk_number), null where the shape is wrong."""
    part = lambda k: F.regexp_extract(value, CHUNK_ID, k)
    shaped = F.struct(part(1).alias("document_id"), F.concat(part(1), F.lit("-sec-"), part(2)).alias("section_id"), part(2).cast("int").alias("section_number"), part(3).cast("int").alias("chunk_number"))
    return F.when(value.rlike(CHUNK_ID), shaped)


def render_block(kind: Column, text: Column, level: Column, language: Column) -> Column:
    """Markdown of one block."""
    return (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), F.least(F.greatest(level, F.lit(1)), F.lit(6))), F.lit(" "), text))
        .when(kind == "code", F.concat(F.lit("```"), F.coalesce(language, F.lit("")), F.lit("\n"), text, F.lit("\n```")))
        .otherwise(text)
    )


def canonical_json(**fields: Column) -> Column:
    """Keys in order, nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def evidence_words(text: Column) -> Column:
    """P22 before anything is left out: lower-case words, camelCase and ``_ -`` split; some may be empty. The words of a text are
    worked on as one line, as an expression for each word costs many times that."""
    line = F.array_join(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(EVIDENCE_TOKEN), F.lit(0)), " ")
    return F.split(F.lower(F.regexp_replace(line, "[_-]|(?<=[a-z0-9])(?=[A-Z])", " ")), " ", -1)


def evidence_tokens(text: Column) -> Column:
    """Different lower-case words of two letters or more, camelCase and ``_ -`` split, stop words left out."""
    return F.array_distinct(F.filter(evidence_words(text), lambda x: (F.length(x) >= 2) & ~x.isin(*STOP_WORDS)))


def citation_markers(answer: Column) -> Column:
    """Markers such as [C1] in order of first use."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(MARKER), F.lit(1)))


def contains_quote(source: Column, quote: Column) -> Column:
    """The quote stands in the source, Unicode white space and case aside; an empty quote doesn't, nor any in null text.

    Upper then lower case is full case folding (ß as ss) but for two letters: a capital ẞ is made ss before, and a dotless i takes
    the place it leaves, as it would become i. The sigma between them has one lower form wherever it stands, and keeps Spark from
    dropping the upper case as without effect."""
    plain = lambda c: F.translate(F.replace(c, F.lit("ẞ"), F.lit("ss")), "ı", "ẞ")
    flat = lambda c: F.lower(F.translate(F.upper(plain(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, " ")))), "Σ", "σ"))
    return (flat(quote) != "") & F.contains(flat(source), flat(quote))


def csv_safe(value: Column) -> Column:
    """K6: no spreadsheet takes the value for a formula."""
    return F.when(F.ltrim(value).rlike(r"\A[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(value)


def size_text(n: Column) -> Column:
    """Bytes as B, KB or MB."""
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024 * 1024, F.format_string("%.1f KB", F.bround(n / 1024, 1))).otherwise(F.format_string("%.1f MB", F.bround(n / (1024 * 1024), 1)))


def prepared_query(text: Column, prefix: str = "") -> Column:
    """White space collapsed; an empty query is an error."""
    t = normal_space(F.coalesce(text, F.lit("")))
    return F.when(t == "", F.raise_error(F.lit("a query must have text")).cast("string")).otherwise(F.concat(F.lit(prefix), t))


def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Unicode NFC; Spark has no expression for it."""
    return F.pandas_udf(_nfc, "string")(text)


def tidy(text: Column) -> Column:
    """P9 without NFC: line ends, blanks before line ends, at most one empty line."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))
