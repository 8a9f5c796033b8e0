"""Table checks that fail closed: every rule is a DataFrame of (rule, key, detail), all are collected before anything stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .corpus import all_violations, violation
from .planning import DIFFICULTIES, MATRIX, SPLITS, TOTAL

#: Shapes of ids, domains with their number of documents, counts of the question set by split and answerability.
DOCUMENT_ID, QUESTION_ID = r"\A[a-z0-9]+-[0-9]{3}\z", r"\Ak8s-[0-9]{3}\z"
DOMAINS = {"cluster_architecture": 7, "workloads": 15, "services_networking": 10, "storage": 8, "configuration": 5, "security_policies": 9, "scheduling_resource_management": 7}
GOLDEN_COUNTS = {("dev", True): 54, ("dev", False): 6, ("test", True): 36, ("test", False): 4}
NEGATIVE = "negative_near_miss"


def manifest_violations(manifest: DataFrame, hosts: tuple[str, ...], counts: dict[str, int] | None = None) -> DataFrame:
    """fields, id shape, domain, https url on an allowed host without query, fragment or user, repeated ids, titles and urls, and
    documents per domain."""
    m, key, u = manifest, F.col("id"), F.coalesce("url", F.lit(""))
    parts = [violation(m, f"missing_{c}", key, F.trim(F.coalesce(c, F.lit(""))) == "") for c in ("id", "domain", "title", "url", "rationale")]
    host = F.lower(F.regexp_extract(u, r"^https://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    parts += [
        violation(m, "id_shape", key, ~key.rlike(DOCUMENT_ID), key),
        violation(m, "unknown_domain", key, ~F.col("domain").isin(*DOMAINS), F.col("domain")),
        violation(m, "url_rule", key, ~u.startswith("https://") | u.rlike(r"[?#]|^https://[^/]*@") | ~host.isin(*hosts), u),
    ]
    for c in ("id", "title", "url"):
        parts.append(violation(m.groupBy(c).count(), f"repeated_{c}", F.col(c), F.col("count") > 1, F.col("count")))
    wanted = m.sparkSession.createDataFrame(list((counts or DOMAINS).items()), "domain string, wanted long")
    have = wanted.join(m.groupBy("domain").count(), "domain", "left").withColumn("have", F.coalesce("count", F.lit(0)))
    parts.append(violation(have, "domain_count", F.col("domain"), F.col("have") != F.col("wanted"), F.col("have")))
    return all_violations(*parts)


def golden_violations(questions: DataFrame, strict: bool = True) -> DataFrame:
    """F13 over questions with relevance_judgments array<struct<chunk_id, grade>>."""
    q, key = questions, F.col("question_id")
    j = F.col("relevance_judgments")
    positive = F.size(F.filter(F.coalesce(j, F.array()), lambda x: x["grade"] > 0)) if "relevance_judgments" in q.columns else F.lit(0)
    chunk_ids = F.transform(j, lambda x: x["chunk_id"])
    parts = [
        violation(q, "question_id_shape", key, key.isNull() | ~key.rlike(QUESTION_ID), key),
        violation(q.groupBy("question_id").count(), "repeated_question_id", key, F.col("count") > 1),
        violation(q, "empty_question", key, F.trim(F.coalesce("question", F.lit(""))) == ""),
        violation(q, "unknown_category", key, ~F.coalesce(F.col("category").isin(*[m[0] for m in MATRIX]), F.lit(False)), F.col("category")),
        violation(q, "unknown_difficulty", key, ~F.coalesce(F.col("difficulty").isin(*DIFFICULTIES), F.lit(False)), F.col("difficulty")),
        violation(q, "unknown_split", key, ~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)), F.col("split")),
        violation(q, "answerable_missing", key, F.col("answerable").isNull()),
        violation(q, "judgments_missing", key, j.isNull()),
        violation(q, "chunk_id_shape", key, F.exists(j, lambda x: x["chunk_id"].isNull() | ~x["chunk_id"].rlike(T.CHUNK_ID))),
        violation(q, "repeated_judgment", key, F.size(F.array_distinct(chunk_ids)) != F.size(chunk_ids)),
        violation(q, "grade_range", key, F.exists(j, lambda x: x["grade"].isNull() | ~x["grade"].between(0, 3))),
        violation(q, "answerable_without_evidence", key, F.col("answerable") & (positive == 0)),
        violation(q, "negative_with_evidence", key, ~F.col("answerable") & (positive > 0)),
        violation(q, "negative_category_mismatch", key, (F.col("category") == NEGATIVE) == F.col("answerable")),
    ]
    if strict:
        wanted = q.sparkSession.createDataFrame([(s, a, n) for (s, a), n in GOLDEN_COUNTS.items()], "split string, answerable boolean, wanted long")
        have = q.groupBy("split", "answerable").count().join(wanted, ["split", "answerable"], "full_outer")
        label = F.concat_ws("/", "split", F.col("answerable").cast("string"))
        parts.append(violation(have, "split_count", label, ~F.col("count").eqNullSafe(F.col("wanted")), F.col("count")))
        parts.append(violation(q.agg(F.count("*").alias("n")), "total", F.lit("questions"), F.col("n") != TOTAL, F.col("n")))
    return all_violations(*parts)


def block_violations(documents: DataFrame) -> DataFrame:
    """F8 over extracted documents with blocks array<struct<block_index, type, level, text>>."""
    b = documents.select("document_id", F.posexplode("blocks").alias("pos", "b")).select("document_id", "pos", "b.*")
    heading = F.col("type") == "heading"
    no_heading = documents.where(~F.exists("blocks", lambda x: x["type"] == "heading"))
    return all_violations(
        violation(b, "block_index", F.col("document_id"), ~F.col("block_index").eqNullSafe(F.col("pos")), F.col("pos")),
        violation(b, "heading_level", F.col("document_id"), heading & ~F.coalesce(F.col("level").between(1, 6), F.lit(False)), F.col("pos")),
        violation(b, "empty_heading", F.col("document_id"), heading & (F.trim(F.coalesce("text", F.lit(""))) == ""), F.col("pos")),
        violation(no_heading, "no_heading", F.col("document_id"), F.lit(True)),
    )


def section_violations(sections: DataFrame) -> DataFrame:
    """F9 over sections (document_id, section_order, block_start, block_end, level, parent_order): order without gaps, ranges that
    don't overlap, parents that exist, come before and are shallower."""
    w = Window.partitionBy("document_id").orderBy("section_order")
    s = sections.withColumns({"__n": F.row_number().over(w), "__end": F.lag("block_end").over(w)})
    key = F.concat_ws("#", "document_id", "section_order")
    parent = sections.select("document_id", F.col("section_order").alias("parent_order"), F.col("level").alias("__level"))
    p = s.where("parent_order IS NOT NULL").join(parent, ["document_id", "parent_order"], "left")
    return all_violations(
        violation(s, "section_order", key, F.col("section_order") != F.col("__n")),
        violation(s, "block_range", key, F.col("block_end") < F.col("block_start")),
        violation(s, "overlapping_range", key, F.col("block_start") <= F.col("__end")),
        violation(p, "unknown_parent", key, F.col("__level").isNull()),
        violation(p, "parent_order", key, F.col("parent_order") >= F.col("section_order")),
        violation(p, "parent_level", key, F.col("__level") >= F.col("level")),
    )


def select_ids(df: DataFrame, key: str, ids: list[str]) -> DataFrame:
    """the rows with these ids; a repeated or unknown id is an error."""
    if len(set(ids)) != len(ids):
        raise ValueError("an id is named twice")
    asked = df.sparkSession.createDataFrame([(i,) for i in ids], f"{key} {df.schema[key].dataType.simpleString()}")
    gone = [r[0] for r in asked.join(df.select(key), key, "left_anti").collect()]
    if gone:
        raise ValueError(f"unknown ids: {sorted(gone)}")
    return df.join(asked, key, "left_semi")
