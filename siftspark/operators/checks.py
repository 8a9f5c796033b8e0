"""Selections, table checks, chunk audits, stage reports and answerability of several systems at once.

Checks give rows (rule, key, detail) like those of ``corpus``; nothing is gathered to be checked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import is_unit
from .corpus import all_violations, violation
from .metrics import EDGE, running

#: The counts that an evaluation of the development questions must find.
DEV_ROWS, DEV_ANSWERABLE = 60, 54
#: Severities of the chunk audit; what isn't listed is an error.
WARNINGS = ("duplicate_chunk_content_hashes", "very_short_chunks")
#: What a factuality review may say of an answer and of its citations.
CORRECTNESS = ("correct_complete", "correct_incomplete", "incorrect", "needs_review", "not_applicable")
CITATION = ("fully_supported", "partially_supported", "unsupported", "needs_review", "not_applicable")


def in_split(questions: DataFrame, split: str) -> DataFrame:
    """the questions of dev or test, or all."""
    if split not in ("dev", "test", "all"):
        raise ValueError(f"unknown split {split}")
    return questions if split == "all" else questions.where(F.col("split") == split)


def select_rows(df: DataFrame, order: list[str], limit: int | None = None, **wanted: list | None) -> DataFrame:
    """rows whose columns hold one of the wanted values, and of them the first ``limit`` in order; no values, no filter."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be positive")
    keep = [F.col(c).isin(list(v)) for c, v in wanted.items() if v]
    rows = df.where(reduce(Column.__and__, keep)) if keep else df
    return rows if limit is None else rows.orderBy(*order).limit(limit)


def field_faults(df: DataFrame, key: Column, required: tuple[str, ...] = (), filled: tuple[str, ...] = (), one_of: dict[str, tuple] | None = None, hashes: dict[str, Column] | None = None, unique: bool = True) -> DataFrame:
    """missing and blank fields, values outside an enumeration, hashes that recompute otherwise, repeated keys. One pass names
    all faults of a row; only repeated keys need a shuffle."""
    bad = {f"missing_{c}": F.col(c).isNull() for c in required} | {f"blank_{c}": F.trim(F.coalesce(c, F.lit(""))) == "" for c in filled}
    bad |= {f"unknown_{c}": F.col(c).isNotNull() & ~F.col(c).isin(*v) for c, v in (one_of or {}).items()}
    bad |= {f"{c}_differs": ~F.col(c).eqNullSafe(h) for c, h in (hashes or {}).items()}
    rows = df.select(key.cast("string").alias("key"), F.explode(_named(bad)).alias("rule"))
    out = rows.select("rule", "key", F.lit("").alias("detail"))
    return out.unionByName(violation(df.groupBy(key.alias("k")).count(), "repeated_key", F.col("k"), F.col("count") > 1, F.col("count"))) if unique else out


def _named(bad: dict[str, Column]) -> Column:
    """The names of the conditions that hold."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in bad.items()]))


def dev_only_faults(questions: DataFrame, rows: int = DEV_ROWS, answerable: int = DEV_ANSWERABLE) -> DataFrame:
    """what forbids a development-only step: questions of another split, and other counts than the frozen ones."""
    n = questions.agg(F.count("*").alias("rows"), F.count_if("answerable").alias("answerable"))
    return all_violations(
        violation(questions, "not_dev", F.col("question"), ~F.col("split").eqNullSafe("dev"), F.col("split")),
        violation(n, "row_count", F.lit("all"), F.col("rows") != rows, F.col("rows")),
        violation(n, "answerable_count", F.lit("all"), F.col("answerable") != answerable, F.col("answerable")),
    )


def dense_index_faults(index: DataFrame, chunks: int, width: int, vector: str = "vector") -> DataFrame:
    """a dense index (row_index, vector) must have a unit vector of the width for each chunk, numbered from 0 without gap."""
    facts = index.agg(F.count("*").alias("n"), F.count_distinct("row_index").alias("d"), F.min("row_index").alias("low"), F.max("row_index").alias("high"))
    numbered = (F.col("d") == F.col("n")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1)
    v = F.col(vector)
    return all_violations(
        violation(facts, "row_count", F.lit("index"), F.col("n") != chunks, F.col("n")),
        violation(facts, "row_index_gap", F.lit("index"), (F.col("n") > 0) & ~numbered, F.col("high")),
        violation(index, "vector_width", F.col("row_index"), v.isNull() | (F.size(v) != width), F.size(v)),
        violation(index, "not_a_unit_vector", F.col("row_index"), (F.size(v) == width) & ~is_unit(v)),
    )


def attach_vectors(metadata: DataFrame, matrix: DataFrame) -> DataFrame:
    """Metadata and matrix by row_index; a row that the other side lacks is an error when it is read."""
    both = metadata.withColumn("__meta", F.lit(True)).join(matrix.withColumn("__matrix", F.lit(True)), "row_index", "full_outer")
    whole = F.col("__meta").isNotNull() & F.col("__matrix").isNotNull()
    checked = F.when(whole, F.col("row_index")).otherwise(F.raise_error(F.concat(F.lit("no counterpart of row "), F.col("row_index").cast("string"))).cast("long"))
    return both.withColumn("row_index", checked).drop("__meta", "__matrix")


def prepared_differences(before: DataFrame, after: DataFrame, key: str, position: str, content: str) -> DataFrame:
    """what a preparation must not do to a corpus: lose or add rows, move them, change their content."""
    b = before.select(key, F.col(position).alias("__p"), F.col(content).alias("__c"), F.lit(True).alias("__b"))
    a = after.select(key, F.col(position).alias("__q"), F.col(content).alias("__d"), F.lit(True).alias("__a"))
    j = b.join(a, key, "full_outer")
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    bad = {"lost": F.col("__a").isNull(), "added": F.col("__b").isNull(), "moved": both & (F.col("__p") != F.col("__q")), "changed": both & ~F.col("__c").eqNullSafe(F.col("__d"))}
    return j.select(F.explode(_named(bad)).alias("rule"), F.col(key).cast("string").alias("key"))


def judgment_map(judgments: Column) -> Column:
    """array<struct<chunk_id, grade>> as a map; of a chunk that is judged twice the last grade counts."""
    later = lambda x, i: F.exists(F.slice(judgments, i + 2, F.size(judgments)), lambda y: y["chunk_id"] == x["chunk_id"])
    return F.map_from_entries(F.transform(F.filter(judgments, lambda x, i: ~later(x, i)), lambda x: F.struct(x["chunk_id"], x["grade"])))


def audit_chunks(chunks: DataFrame, sections: DataFrame, manifest: DataFrame, id_shape: str) -> DataFrame:
    """Chunks against their section and document, in 13 rules. A chunk's ten are judged in one row after two lookups.

    chunks: chunk_id, chunk_index, section_id, document_id, domain, url, heading_path, section_hash, document_hash;
    sections: section_id, document_id, heading_path, section_hash; manifest: document_id, domain, url, document_hash.
    """
    s = sections.select("section_id", *[F.col(c).alias(f"s_{c}") for c in ("document_id", "heading_path", "section_hash")], F.lit(True).alias("in_sections"))
    m = manifest.select("document_id", *[F.col(c).alias(f"m_{c}") for c in ("domain", "url", "document_hash")], F.lit(True).alias("in_manifest"))
    j = chunks.join(s, "section_id", "left").join(m, "document_id", "left")
    section, document = F.col("in_sections").isNotNull(), F.col("in_manifest").isNotNull()
    differs = lambda side, there, c: there & ~F.col(c).eqNullSafe(F.col(f"{side}_{c}"))
    shape = F.coalesce(F.col("chunk_id").rlike(id_shape), F.lit(False))
    bad = {
        "chunk_id_shape": ~shape,
        "chunk_index_mismatch": shape & ~F.regexp_extract("chunk_id", id_shape, 1).try_cast("long").eqNullSafe(F.col("chunk_index").cast("long")),
        "orphan_chunk": ~section,
        "unknown_document": ~document,
        "document_mismatch": differs("s", section, "document_id"),
        "heading_path_mismatch": differs("s", section, "heading_path"),
        "section_hash_mismatch": differs("s", section, "section_hash"),
        "domain_mismatch": differs("m", document, "domain"),
        "url_mismatch": differs("m", document, "url"),
        "document_hash_mismatch": differs("m", document, "document_hash"),
    }
    own = j.select(F.explode(_named(bad)).alias("rule"), F.col("chunk_id").cast("string").alias("key"), F.lit("").alias("detail"))
    alone = lambda left, right, c, rule: violation(left.join(right, c, "left_anti"), rule, F.col(c), F.lit(True))
    return all_violations(
        own,
        alone(sections, chunks, "section_id", "section_without_chunks"),
        alone(manifest, sections, "document_id", "document_without_sections"),
        alone(manifest, chunks, "document_id", "document_without_chunks"),
    )


def audit_verdict(violations: DataFrame, warnings: tuple[str, ...] = WARNINGS) -> DataFrame:
    """Errors, warnings and FAIL, WARN or PASS."""
    warning = F.col("rule").isin(*warnings) if warnings else F.lit(False)
    n = violations.agg(F.count_if(~warning).alias("errors"), F.count_if(warning).alias("warnings"))
    return n.withColumn("status", F.when(F.col("errors") > 0, "FAIL").when(F.col("warnings") > 0, "WARN").otherwise("PASS"))


def stage_report(df: DataFrame, status: Column, **sums: Column) -> DataFrame:
    """Rows by status with totals, and all of them together, in one pass."""
    g = df.select(status.alias("status"), *[c.alias(n) for n, c in sums.items()]).rollup("status")
    out = g.agg(F.grouping("status").alias("all"), F.count("*").alias("rows"), *[F.sum(n).alias(n) for n in sums])
    return out.withColumn("status", F.when(F.col("all") == 1, "all").otherwise(F.coalesce("status", F.lit("none")))).drop("all")


def length_audit(lengths: DataFrame, limit: int) -> DataFrame:
    """C26 for several variants (variant, n) at once: how many texts are longer than a model takes, and what would be lost."""
    n = F.col("n")
    q = lambda p: F.round(F.percentile("n", F.lit(p)), 3)
    return lengths.groupBy("variant").agg(F.count("*").alias("rows"), F.count_if(n > limit).alias("truncated"), F.sum(F.greatest(n - limit, F.lit(0))).alias("lost"), F.max("n").alias("longest"), q(0.5).alias("median"), q(0.9).alias("p90"), q(0.95).alias("p95"))


def system_thresholds(scores: DataFrame) -> DataFrame:
    """C11 over (system, split, score, positive): for each system the threshold that is best on dev, and how it does on test.

    Scores are counted first and sorted in slices, so neither a system nor a score meets every threshold in one task. Candidates
    are the midpoints of neighbouring scores and one beyond either end.
    """
    by = scores.groupBy("system", "split", "score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))
    ranked = running(by, "score", ("p", "n"), keys=("system", "split")).withColumns({
        "p_below": F.col("to_p") - F.col("p"), "n_below": F.col("to_n") - F.col("n"), "last": F.col("score") == F.col("last_value"),
    })
    wins = F.try_divide(F.sum(F.col("p") * (F.col("n_below") + F.col("n") / 2)), F.first(F.col("all_p") * F.col("all_n")))
    areas = ranked.groupBy("system", "split").agg(F.round(wins, 6).alias("auroc"))
    # A threshold just below a score rejects what is below it; the one beyond the last score rejects all.
    cut = F.struct(F.coalesce((F.col("previous") + F.col("score")) / 2, F.col("score") - EDGE).alias("threshold"), F.col("p_below").alias("fn"), F.col("n_below").alias("tn"))
    end = F.struct((F.col("score") + EDGE).alias("threshold"), F.col("all_p").alias("fn"), F.col("all_n").alias("tn"))
    cuts = ranked.where("split = 'dev'").select("system", "all_p", "all_n", F.inline(F.array_compact(F.array(cut, F.when(F.col("last"), end)))))
    best = cuts.select("system", "threshold", *_rates(F.col("all_p") - F.col("fn"), F.col("fn"), F.col("tn"), F.col("all_n") - F.col("tn")))
    chosen = best.groupBy("system").agg(F.max(F.struct("balanced_accuracy", "rejection", "recall", "threshold")).alias("b")).select("system", F.col("b.threshold").alias("threshold"), F.col("b.balanced_accuracy").alias("dev_balanced_accuracy"))
    hit = F.col("score") >= F.col("threshold")
    tallies = by.where("split = 'test'").join(F.broadcast(chosen), "system").groupBy("system").agg(*[F.sum(F.when(c, F.col(x)).otherwise(0)).alias(k) for k, x, c in (("tp", "p", hit), ("fn", "p", ~hit), ("tn", "n", ~hit), ("fp", "n", hit))])
    auroc = areas.groupBy("system").agg(*[F.max(F.when(F.col("split") == s, F.col("auroc"))).alias(f"{s}_auroc") for s in ("dev", "test")])
    return chosen.join(tallies, "system").join(auroc, "system").select("system", "threshold", "dev_balanced_accuracy", "dev_auroc", "test_auroc", *_rates(F.col("tp"), F.col("fn"), F.col("tn"), F.col("fp")))


def _rates(tp: Column, fn: Column, tn: Column, fp: Column) -> list[Column]:
    tpr, tnr = (F.coalesce(F.try_divide(a, a + b), F.lit(0.0)) for a, b in ((tp, fn), (tn, fp)))
    return [F.round(tpr, 6).alias("recall"), F.round(tnr, 6).alias("rejection"), F.round((tpr + tnr) / 2, 6).alias("balanced_accuracy")]


def factuality_faults(reviews: DataFrame) -> DataFrame:
    """Labels outside the enumerations; an answer that was given must be judged, and one that wasn't must not."""
    answered = F.col("status") == "answered"
    bad = {
        "unknown_correctness": ~F.coalesce(F.col("correctness").isin(*CORRECTNESS), F.lit(False)),
        "unknown_citation": ~F.coalesce(F.col("citation").isin(*CITATION), F.lit(False)),
        "answer_not_judged": answered & ((F.col("correctness") == "not_applicable") | (F.col("citation") == "not_applicable")),
        "judged_without_answer": ~answered & ((F.col("correctness") != "not_applicable") | (F.col("citation") != "not_applicable")),
    }
    return reviews.select(F.explode(_named(bad)).alias("rule"), F.col("key").cast("string").alias("key"))


def factuality_scores(reviews: DataFrame) -> DataFrame:
    """One row of tallies and rates over (status, answerable, correctness, citation)."""
    has = lambda c, v: F.count_if(F.col(c) == v)
    judged = F.count_if(F.col("correctness").isin(*CORRECTNESS[:3]))
    share = lambda a: F.round(F.try_divide(a, judged), 6)
    return reviews.agg(
        F.count("*").alias("rows"),
        judged.alias("assessed"),
        *[has("correctness", v).alias(v) for v in CORRECTNESS[:3]],
        *[has("citation", v).alias(f"citation_{v}") for v in CITATION[:3]],
        share(has("correctness", "correct_complete")).alias("accuracy_complete_only"),
        share(F.count_if(F.col("correctness").isin(*CORRECTNESS[:2]))).alias("accuracy_allow_incomplete"),
        F.count_if((F.col("status") == "answered") & ~F.col("answerable")).alias("negative_false_answers"),
    )


def prompts(question: Column, answer: Column, evidence: Column, findings: Column) -> dict[str, Column]:
    """What models are asked, as JSON payloads: to answer, to verify an answer, to repair one, and to answer from the sources
    again. ``evidence`` is array<struct<id, text>>. Gold labels are in none of them."""
    body = lambda **c: F.to_json(F.struct(*[v.alias(k) for k, v in c.items()]), {"ignoreNullFields": "false"})
    return {
        "ask": body(question=question, evidence=evidence),
        "verify": body(question=question, answer=answer, evidence=evidence),
        "repair": body(question=question, answer=answer, findings=findings, evidence=evidence),
        "replay": body(question=question, evidence=F.filter(evidence, lambda e: F.trim(e["text"]) != "")),
    }
