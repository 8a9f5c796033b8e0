"""Audits of reviews, merges and releases: faults as rows, tallies as small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .corpus import all_violations

#: What a review may say of the evidence, and what it may not say without any.
RELATIONS = ("supported", "contradicted", "partial", "insufficient", "unclear")
NEEDS_EVIDENCE = ("supported", "contradicted", "partial")


def review_faults(original: DataFrame, review: DataFrame) -> DataFrame:
    """(rule, key). originals (key, text) and reviews (key, text, relation, confidence, has_evidence) must match one to one,
    text unchanged; a relation needs a confidence and the other way round."""
    fault = lambda df, rule, bad: df.where(bad).select(F.lit(rule).alias("rule"), "key")
    both = review.join(original.select("key", F.col("text").alias("__text")), "key")
    said = F.coalesce("relation", F.lit("")) != ""
    twice = review.groupBy("key").count().where("count > 1").drop("count")
    return all_violations(
        fault(original.join(review.select("key"), "key", "left_anti"), "missing_review", F.lit(True)),
        fault(review.join(original.select("key"), "key", "left_anti"), "unknown_review", F.lit(True)),
        fault(twice, "repeated_review", F.lit(True)),
        fault(both, "text_changed", ~F.col("text").eqNullSafe(F.col("__text"))),
        fault(review, "unknown_relation", said & ~F.col("relation").isin(*RELATIONS)),
        fault(review, "confidence_without_relation", ~said & F.col("confidence").isNotNull()),
        fault(review, "relation_without_confidence", said & ~F.coalesce(F.col("confidence").isin(0, 1, 2), F.lit(False))),
        fault(review, "judged_without_evidence", ~F.col("has_evidence") & F.col("relation").isin(*NEEDS_EVIDENCE)),
    )


def review_tallies(review: DataFrame) -> DataFrame:
    """Rows by relation; those without one are open."""
    name = F.coalesce(F.nullif(F.col("relation"), F.lit("")), F.lit("open"))
    return review.groupBy(name.alias("relation")).agg(F.count("*").alias("rows"), F.sum(F.col("has_evidence").cast("long")).alias("with_evidence"))


def reconcile(base: DataFrame, recovered: DataFrame) -> DataFrame:
    """(key, score, status). A recovered row fills an open one; over a scored one it is a conflict and changes nothing."""
    j = base.join(recovered.select("key", F.col("score").alias("__new"), F.lit(True).alias("__has")), "key", "left")
    status = F.when(F.col("__has").isNull(), "kept").when(F.col("score").isNull(), "recovered").otherwise("conflict")
    return j.select("key", F.when(status == "recovered", F.col("__new")).otherwise(F.col("score")).alias("score"), status.alias("status"))


def fingerprint(rows: DataFrame, key: str) -> DataFrame:
    """sha256 over the rows' digests in key order. Each row is 64 characters there, and the set under review is bounded by
    hand labelling; for large tables use per-partition digests."""
    line = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), line.alias("d"))))
    return rows.agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["d"]), "\n"), 256).alias("fingerprint"), F.count("*").alias("rows"))


def release_gates(facts: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """(gate, status) from one row of facts; a null is a failure."""
    cells = F.array(*[F.struct(F.lit(n).alias("gate"), F.when(F.coalesce(c, F.lit(False)), "pass").otherwise("fail").alias("status")) for n, c in gates.items()])
    return facts.select(F.explode(cells).alias("g")).select("g.*")
