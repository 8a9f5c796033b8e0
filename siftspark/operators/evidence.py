"""Evidence for answers: budgets, snippet ranking, citation checks, verdict ladders, and the states of repair and replay.

Answers are rows; every rule is an expression over them. Only the chat model is outside (see ``sources.chat``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Budgets, caps and score parts.
EXCERPT, BUDGET, LEAST_LEFT = 1500, 10_500, 100
PASSAGE_BUDGET, PASSAGE_LEAST = 4800, 80
TOP_SOURCES, MAX_SNIPPETS, PER_SOURCE = 4, 6, 2
RANK_WEIGHT, ODD_START_PENALTY, SCORE_DIGITS = 0.22, 0.3, 5
ODD_START = r"\A\s*(?:```|\| |\[|#### Note:)"
PLACEHOLDER = r"(?i)\b(?:the documented claim goes here|insert (?:the |your )?(?:answer|claim) here|lorem ipsum|placeholder answer)\b"
TRUNCATED = " [TRUNCATED EXCERPT]"
GENERATION = "abstain boolean, answer string, citations array<string>"
#: Rows up to which a table is held by every task.
HELD_ROWS = 200_000
VERDICTS = ("supported", "unsupported", "contradicted", "uncertain")
BLOCKING = ("unsupported", "contradicted")


def select_evidence(hits: DataFrame, question: str = "question", budget: int = BUDGET, excerpt: int = EXCERPT, least: int = LEAST_LEFT) -> DataFrame:
    """Hits (question, chunk, rank, text) in rank order; the first of each chunk, none without text, excerpts of at most
    ``excerpt`` characters until less than ``least`` of the budget is left."""
    first = F.row_number().over(Window.partitionBy(question, "chunk").orderBy("rank"))
    rows = hits.withColumn("__first", first).where("__first = 1").drop("__first").where(F.trim(F.coalesce("text", F.lit(""))) != "")
    run = Window.partitionBy(question).orderBy("rank", "chunk")
    n = F.least(F.length("text"), F.lit(excerpt))
    left = F.lit(budget) - F.coalesce(F.sum(n).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("__left", left).where(F.col("__left") >= least)
    size = F.least(F.length("text"), F.lit(excerpt), F.col("__left")).cast("int")
    cut = F.length("text") > size
    body = F.concat(F.substring("text", F.lit(1), size), F.when(cut, F.lit(TRUNCATED)).otherwise(""))
    return rows.select(question, "chunk", "rank", F.concat(F.lit("C"), F.row_number().over(run).cast("string")).alias("evidence_id"), size.cast("long").alias("chars"), cut.alias("truncated"), body.alias("excerpt"))


def held(df: DataFrame) -> DataFrame:
    """A table of at most HELD_ROWS rows for every task to hold; a larger one stays as it is, for a plain join."""
    rows = df.limit(HELD_ROWS + 1).collect()
    return df if len(rows) > HELD_ROWS else F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def rank_snippets(units: DataFrame, questions: DataFrame, max_snippets: int = MAX_SNIPPETS, per_source: int = PER_SOURCE) -> DataFrame:
    """Units (question, chunk, rank, lo, hi, quote) scored by the terms they share with the text of their question
    (question, question_text), rarer terms among the question's own units first; at most per_source of a chunk and max_snippets in all.

    A question's text is cut once, not for each unit. The terms of units are looked up where they are read; what moves is a count a
    term, then a sum a unit. The terms themselves are found again for the few units that are kept.
    """
    if max_snippets < 1 or per_source < 1:
        raise ValueError("max_snippets and per_source must be positive")
    key = ["question", "chunk", "lo", "hi"]
    # No word is a blank: each unit has it once, so its count is that of the question's units, and units without terms stay.
    asked = questions.select("question", F.explode(F.array_append(T.evidence_tokens(F.col("question_text")), F.lit(" "))).alias("term"))
    asked = held(asked)
    words = lambda df, *more: df.select(*key, *more, F.explode(F.array_append(F.array_distinct(T.evidence_words(F.col("quote"))), F.lit(" "))).alias("term"))
    by_term = words(units).join(asked, ["question", "term"], "left_semi").groupBy("question", "term").agg(F.count("*").alias("f"))
    total = F.max(F.when(F.col("term") == " ", F.col("f"))).over(Window.partitionBy("question"))
    weight = F.when(F.col("term") == " ", 0.0).otherwise(1 + F.log((total + 1) / (F.col("f") + 1)))
    weights = held(by_term.select("question", "term", weight.alias("w")))
    odd = F.when(F.col("quote").rlike(ODD_START), ODD_START_PENALTY).otherwise(0.0)
    sums = words(units, "rank", odd.alias("odd")).join(weights, ["question", "term"]).groupBy(*key).agg(F.sum("w").alias("w"), F.min("rank").alias("rank"), F.max("odd").alias("odd"))
    scored = sums.withColumn("lexical_score", F.round(F.col("w") + RANK_WEIGHT / F.greatest("rank", F.lit(1)) - F.col("odd"), SCORE_DIGITS))
    order = [F.desc("lexical_score"), "rank", "lo", "chunk", "hi"]
    best = lambda df, n, *by: df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= n)
    kept = held(best(best(scored, per_source, "question", "chunk"), max_snippets, "question").select(*key, "rank", "lexical_score", "__n"))
    own = words(units.join(kept.select(*key), key, "left_semi")).where("term <> ' '").join(asked, ["question", "term"], "left_semi")
    terms = own.groupBy(*key).agg(F.array_sort(F.collect_set("term")).alias("terms"))
    out = kept.join(terms, key, "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
    return out.select("question", F.concat(F.lit("E"), F.col("__n").cast("string")).alias("evidence_id"), "chunk", "rank", "lo", "hi", "terms", "lexical_score")


def first_sources(sources: DataFrame, question: str, chunk: str, rank: str) -> DataFrame:
    """One row per cited source, the first."""
    return sources.withColumn("__n", F.row_number().over(Window.partitionBy(question, chunk).orderBy(rank))).where("__n = 1").drop("__n")


def parse_generation(raw: Column, known: Column) -> Column:
    """P25: struct(abstain, answer, citations, error). ``known`` holds the evidence ids of the row."""
    j = F.from_json(raw, GENERATION, {"mode": "PERMISSIVE"})
    abstain, answer, cited = j["abstain"], F.trim(F.coalesce(j["answer"], F.lit(""))), F.coalesce(j["citations"], F.array().cast("array<string>"))
    marks = T.citation_markers(answer)
    error = (
        F.when(abstain.isNull() | j["answer"].isNull() | j["citations"].isNull(), "malformed")
        .when(abstain & ((answer != "") | (F.size(cited) > 0)), "abstention_with_content")
        .when(abstain, F.lit(None).cast("string"))
        .when(answer == "", "empty_answer")
        .when(F.size(marks) == 0, "no_citation")
        .when(marks != cited, "markers_differ_from_citations")
        .when(F.size(F.array_except(marks, known)) > 0, "unknown_citation")
    )
    return F.struct(abstain.alias("abstain"), answer.alias("answer"), cited.alias("citations"), error.alias("error"))


def parse_source_first(raw: Column, known: Column) -> Column:
    """As above, but the citations are what the answer's markers say."""
    j = F.from_json(raw, GENERATION)
    answer = F.trim(F.coalesce(j["answer"], F.lit("")))
    marks = T.citation_markers(answer)
    error = F.when(j["abstain"].isNull(), "malformed").when(j["abstain"], F.lit(None).cast("string")).when(answer == "", "empty_answer").when(F.size(marks) == 0, "no_citation").when(F.size(F.array_except(marks, known)) > 0, "unknown_citation")
    return F.struct(j["abstain"].alias("abstain"), answer.alias("answer"), marks.alias("citations"), error.alias("error"))


def used_citations(answer: Column, listed: Column, known: Column) -> Column:
    """The listed citations cut to those the answer uses, where all used ones are known and listed; else null. The answer
    itself is never touched."""
    marks = T.citation_markers(answer)
    fine = (F.size(marks) > 0) & (F.size(F.array_except(marks, known)) == 0) & (F.size(F.array_except(marks, listed)) == 0)
    return F.when(fine, marks)


def known_chunk_citations(listed: Column, ids: Column, chunks: Column) -> Column:
    """Citations given as chunk ids become evidence ids where exactly one evidence has the chunk; others stay."""
    pairs = F.arrays_zip(ids.alias("i"), chunks.alias("c"))
    return F.transform(listed, lambda x: F.when(F.size(F.filter(pairs, lambda p: p["c"] == x)) == 1, F.get(F.filter(pairs, lambda p: p["c"] == x), F.lit(0))["i"]).otherwise(x))


def structural_checks(status: Column, answer: Column, source_ids: Column, source_text: Column) -> dict[str, Column]:
    """hard_flags and review_flags of an answered row, empty for others."""
    none = F.array().cast("array<string>")
    marks = T.citation_markers(F.coalesce(answer, F.lit("")))
    hard = F.array_compact(F.array(
        F.when(answer.rlike(PLACEHOLDER), "placeholder_answer"),
        F.when((F.size(marks) == 0) | (F.size(source_ids) == 0), "answer_without_cited_evidence"),
        F.when(F.array_sort(marks) != F.array_sort(F.array_distinct(source_ids)), "citation_marker_source_mismatch"),
    ))
    quoted = F.regexp_extract_all(answer, F.lit(r"`([^`\n]{2,100})`"), F.lit(1))
    camel = F.regexp_extract_all(F.regexp_replace(answer, r"`[^`\n]{2,100}`", " "), F.lit(r"\b([A-Za-z][a-zA-Z0-9]*[a-z][A-Z][a-zA-Z0-9]*)\b"), F.lit(1))
    names = F.array_distinct(F.transform(F.concat(quoted, camel), F.trim))
    odd = F.filter(names, lambda x: (F.length(x) >= 3) & ~x.rlike(r"\A\d+\z") & ~x.rlike(r"\s") & ~F.contains(F.lower(F.coalesce(source_text, F.lit(""))), F.lower(x)))
    review = F.transform(odd, lambda x: F.concat(F.lit("unmatched_technical_identifier:"), x))
    answered = status == "answered"
    return {"hard_flags": F.when(answered, hard).otherwise(none), "review_flags": F.when(answered, review).otherwise(none)}


def verified_verdict(verdict: Column, quotes: Column, source_text: Column) -> Column:
    """What the verifier said; supported or contradicted without a quote that stands in the sources is uncertain."""
    good = F.exists(F.coalesce(quotes, F.array().cast("array<string>")), lambda q: T.contains_quote(source_text, q))
    return F.when(verdict.isNull() | ~verdict.isin(*VERDICTS), F.lit(None).cast("string")).when(verdict.isin("supported", "contradicted") & ~good, "uncertain").otherwise(verdict)


def gate_verdict(status: Column, hard_flags: Column, verdict: Column, use_verifier: bool, question_stage: bool = False) -> Column:
    """The ladder from status over structure to the verifier's word."""
    out = F.when(status != "answered", "not_applicable")
    if not question_stage:
        out = out.when(F.size(hard_flags) > 0, "structural_failure")
    return out.otherwise(F.coalesce(verdict, F.lit("verifier_error")) if use_verifier else F.lit("not_semantically_checked"))


def would_block(verdict: Column) -> Column:
    return verdict.isin("structural_failure", *BLOCKING)


def repair_status(status: Column, has_evidence: Column, first: Column, repair_error: Column, repair_abstained: Column, second: Column) -> Column:
    """The ten ends of verify, repair and verify again. ``first`` and ``second`` are gate verdicts."""
    return (
        F.when(status == "abstained", "original_abstained")
        .when(status != "answered", "original_generation_error")
        .when(~has_evidence, "unverified_missing_evidence")
        .when(first == "supported", "accepted_original_provisional")
        .when(~would_block(first), "unverified_original")
        .when(repair_error, "repair_generation_error")
        .when(repair_abstained, "repaired_abstained")
        .when(second == "supported", "accepted_repaired_provisional")
        .when(would_block(second), "blocked_after_repair")
        .otherwise("unverified_after_repair")
    )


def replay_status(status: Column, has_evidence: Column, error: Column, abstained: Column, verdict: Column) -> Column:
    """C20: the eight ends of answering anew from the sources."""
    return (
        F.when(status == "abstained", "original_abstained")
        .when(status != "answered", "original_generation_error")
        .when(~has_evidence, "unverified_missing_evidence")
        .when(error, "regeneration_error")
        .when(abstained, "regenerated_abstained")
        .when(verdict == "supported", "accepted_regenerated_provisional")
        .when(would_block(verdict), "blocked_after_regeneration")
        .otherwise("unverified_regenerated")
    )


def rates(df: DataFrame, parts: dict[str, tuple[Column, Column]], *keys: str) -> DataFrame:
    """Share of rows where the first condition holds among those where the second does; null without any."""
    out = [F.round(F.try_divide(F.sum(F.when(whole & part, 1).otherwise(0)), F.sum(F.when(whole, 1).otherwise(0))), 6).alias(name) for name, (part, whole) in parts.items()]
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), *out)
