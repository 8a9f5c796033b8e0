"""Question-set planning and audits of reviews over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audits as A
from ..operators import planning as P
from ..operators import retrieval as R
from .tables import SQL_TOKENS, chunks, read, vectors


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as labelled seeds: category, difficulty and split by key."""
    s = read(spark, sf_dir, "supplier")
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (F.col("s_suppkey") % by % len(names) + 1).cast("int"))
    return s.select("s_suppkey", pick([m[0] for m in P.MATRIX], 23).alias("category"), pick(P.DIFFICULTIES, 29).alias("difficulty"), pick(P.SPLITS, 31).alias("split"))


def _few(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seeds(spark, sf_dir).where("s_suppkey % 7 = 0")


def f18_quota_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """none in the fixed matrix; one cell raised shows up on all three sums."""
    cells = P.quota_cells(spark)
    return P.quota_faults(cells.withColumn("target", F.when((F.col("category") == "multi_hop") & (F.col("value") == "hard"), F.col("target") + 1).otherwise(F.col("target"))))


def a13_quota_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = P.quota_counts(_seeds(spark, sf_dir))
    return g.select(*[F.coalesce(c, F.lit("-")).alias(c) for c in ("category", "difficulty", "split")], "rows")


def f19_quota_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.quota_excess(P.quota_cells(spark), _seeds(spark, sf_dir))


def w26_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the seeds leave, laid out and interleaved."""
    return P.interleave(P.residual_slots(P.quota_cells(spark), _few(spark, sf_dir))).select("turn", "category", "difficulty", "split")


def w27_free_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.free_numbers(_few(spark, sf_dir), "s_suppkey", 40)


def w22_balanced_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir).withColumn("token_count", F.size(T.tokens(F.col("text"))))
    return P.balanced_anchors(c, 50).select("chunk_id", "domain", "place")


def j17_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors of another section (id divided by 3) for the stated query set."""
    v = vectors(spark, sf_dir)
    found = R.dense_search(v, v.where("vec_id % 100 = 0"), P.NEIGHBOURS + 3, exclude_self=True)
    return R.top_k(found.where(F.floor(F.col("query") / 3) != F.floor(F.col("chunk") / 3)).drop("rank"), P.NEIGHBOURS).select("query", "chunk", "score", "rank")


def w24_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First neighbours of the anchor's label, then of its parity, then any."""
    n = j17_neighbours(spark, sf_dir)
    label = vectors(spark, sf_dir).select("vec_id", "label")
    j = n.join(label.toDF("query", "ql"), "query").join(label.toDF("chunk", "cl"), "chunk").withColumnRenamed("query", "anchor")
    tier = F.when(F.col("ql") == F.col("cl"), 1).when(F.col("ql") % 2 == F.col("cl") % 2, 2).otherwise(3)
    return P.related(j, tier, 4).select("anchor", "chunk", "tier", "place")


def _reviews(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labels as originals and as reviews with edits, gaps and additions."""
    d = read(spark, sf_dir, "labels")
    original = d.select(F.col("doc_id").alias("key"), F.concat(F.lit("text "), F.col("quality").cast("string")).alias("text"))
    review = original.where("key % 17 <> 0").withColumn("text", F.when(F.col("key") % 13 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text")))
    relation = F.element_at(F.array(*map(F.lit, (*A.RELATIONS, ""))), (F.col("key") % 6 + 1).cast("int"))
    confidence = F.when(F.col("key") % 11 == 0, None).otherwise(F.col("key") % 3).cast("int")
    return original, review.withColumns({"relation": relation, "confidence": confidence, "has_evidence": F.col("key") % 9 != 0})


def j10_review_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.review_faults(*_reviews(spark, sf_dir))


def a18_review_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.review_tallies(_reviews(spark, sf_dir)[1])


def j11_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovered rows replace those that have no score yet; replacing a scored row is a fault."""
    d = read(spark, sf_dir, "labels")
    base = d.select(F.col("doc_id").alias("key"), F.when(F.col("toxic") == 1, None).otherwise(F.col("quality")).alias("score"))
    recovered = d.where("doc_id % 10 = 0").select(F.col("doc_id").alias("key"), F.lit(5).alias("score"))
    return A.reconcile(base, recovered)


def a21_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest of the benchmark that doesn't depend on the order of rows."""
    return A.fingerprint(read(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id")


def a25_release_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "labels").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"), F.sum("quality").alias("good"))
    return A.release_gates(d, {"has_rows": F.col("n") > 0, "few_toxic": F.col("toxic") * 2 < F.col("n"), "all_good": F.col("good") == F.col("n")})


def j18_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which facet anchors (first evidence terms of benchmark items) stand in the chunks retrieved for the item."""
    item = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.slice(T.evidence_tokens(F.col("text")), 1, 3).alias("facets"), "text")
    hits = R.bm25_search(chunks(spark, sf_dir), item.select(F.col("query").alias("query_id"), "text"), 3).join(chunks(spark, sf_dir).select(F.col("chunk_id").alias("chunk"), F.col("text").alias("body")), "chunk")
    at = item.select("query", F.explode("facets").alias("facet")).join(hits.select("query", "body"), "query", "left")
    return at.groupBy("query", "facet").agg(F.max(F.coalesce(F.contains(F.lower("body"), F.col("facet")), F.lit(False)).cast("int")).alias("covered"))


QUERIES = {
    f.__name__: f
    for f in (f18_quota_faults, a13_quota_counts, f19_quota_excess, w26_slots, w27_free_numbers, w22_balanced_anchors, j17_neighbours, w24_related, j10_review_faults, a18_review_tallies, j11_reconcile, a21_fingerprint, a25_release_gates, j18_facets)
}

_PICK = "s AS (SELECT s_suppkey, ['direct_factual', 'comparison', 'scenario_application', 'multi_hop', 'troubleshooting', 'negative_near_miss'][s_suppkey % 23 % 6 + 1] AS category, ['easy', 'medium', 'hard'][s_suppkey % 29 % 3 + 1] AS difficulty, ['dev', 'test'][s_suppkey % 31 % 2 + 1] AS split FROM supplier)"
_CELLS = "cells AS (SELECT * FROM (VALUES " + ", ".join(f"('{m[0]}', {i}, '{axis}', '{v}', {j}, {m[off + j]})" for i, m in enumerate(P.MATRIX) for axis, names, off in (("difficulty", P.DIFFICULTIES, 1), ("split", P.SPLITS, 4)) for j, v in enumerate(names)) + ") t(category, category_index, axis, value, value_index, target))"
_HAVE = "have AS (SELECT category, axis, value, count(*) AS have FROM (SELECT category, 'difficulty' AS axis, difficulty AS value, s_suppkey FROM s UNION ALL SELECT category, 'split', split, s_suppkey FROM s) WHERE {w} GROUP BY ALL)"
_NEAR = """pairs AS (SELECT q.vec_id AS query, v.vec_id AS chunk, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND q.vec_id // 3 <> v.vec_id // 3),
near AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk) AS rank FROM pairs QUALIFY rank <= 30)"""
_REVIEW = """o AS (SELECT doc_id AS key, 'text ' || quality AS text FROM labels),
r AS (SELECT key, CASE WHEN key % 13 = 0 THEN text || ' edited' ELSE text END AS text, ['supported', 'contradicted', 'partial', 'insufficient', 'unclear', ''][key % 6 + 1] AS relation, CASE WHEN key % 11 <> 0 THEN CAST(key % 3 AS INTEGER) END AS confidence, key % 9 <> 0 AS has_evidence FROM o WHERE key % 17 <> 0)"""

SQL = {
    "f18_quota_faults": "SELECT * FROM (VALUES ('category_sums_differ', 'multi_hop'), ('value_total', 'hard'), ('axis_total', 'difficulty')) t(rule, key)",
    "a13_quota_counts": f"WITH {_PICK} SELECT coalesce(category, '-') AS category, coalesce(difficulty, '-') AS difficulty, coalesce(split, '-') AS split, count(*) AS rows FROM s GROUP BY GROUPING SETS ((category), (difficulty), (split), (category, difficulty), (category, split))",
    "f19_quota_excess": f"WITH {_PICK}, {_CELLS}, {_HAVE.format(w='true')} SELECT category, axis, value, have, target FROM have LEFT JOIN cells USING (category, axis, value) WHERE have > coalesce(target, 0)",
    "w26_slots": f"""WITH {_PICK}, {_CELLS}, {_HAVE.format(w='s_suppkey % 7 = 0')},
left_ AS (SELECT category, category_index, axis, value, value_index, greatest(target - coalesce(have, 0), 0) AS n FROM cells LEFT JOIN have USING (category, axis, value)),
slots AS (SELECT *, row_number() OVER (PARTITION BY category, axis ORDER BY value_index, i) - 1 AS position, count(*) OVER (PARTITION BY category, axis) AS size FROM (SELECT *, unnest(range(n)) AS i FROM left_)),
turned AS (SELECT *, CASE WHEN axis = 'split' THEN (position - size // 3 + size) % size ELSE position END AS p FROM slots)
SELECT row_number() OVER (ORDER BY d.p, d.category_index) AS turn, d.category, d.value AS difficulty, e.value AS split FROM turned d JOIN turned e ON d.category = e.category AND d.p = e.p WHERE d.axis = 'difficulty' AND e.axis = 'split'""",
    "w27_free_numbers": "SELECT number FROM range(1, 101) t(number) WHERE number NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 = 0) ORDER BY number LIMIT 40",
    "w22_balanced_anchors": f"WITH {SQL_TOKENS}, p AS (SELECT chunk AS chunk_id, lang AS domain, row_number() OVER (PARTITION BY lang ORDER BY len(t) < 64, abs(len(t) - 180), chunk) AS place FROM toks) SELECT * FROM p ORDER BY place, domain LIMIT 50",
    "j17_neighbours": f"WITH {_NEAR} SELECT query, chunk, score, rank FROM near",
    "w24_related": f"""WITH {_NEAR}, t AS (SELECT query AS anchor, chunk, score, CASE WHEN a.label = b.label THEN 1 WHEN a.label % 2 = b.label % 2 THEN 2 ELSE 3 END AS tier FROM near JOIN embeddings a ON a.vec_id = query JOIN embeddings b ON b.vec_id = chunk)
SELECT anchor, chunk, tier, row_number() OVER w AS place FROM t WINDOW w AS (PARTITION BY anchor ORDER BY tier, score DESC, chunk) QUALIFY row_number() OVER w <= 4""",
    "j10_review_faults": f"""WITH {_REVIEW}
SELECT 'missing_review' AS rule, key FROM o WHERE key NOT IN (SELECT key FROM r)
UNION ALL SELECT 'text_changed', key FROM r JOIN o USING (key) WHERE r.text <> o.text
UNION ALL SELECT 'confidence_without_relation', key FROM r WHERE relation = '' AND confidence IS NOT NULL
UNION ALL SELECT 'relation_without_confidence', key FROM r WHERE relation <> '' AND confidence IS NULL
UNION ALL SELECT 'judged_without_evidence', key FROM r WHERE NOT has_evidence AND relation IN ('supported', 'contradicted', 'partial')""",
    "a18_review_tallies": f"WITH {_REVIEW} SELECT coalesce(nullif(relation, ''), 'open') AS relation, count(*) AS rows, count(*) FILTER (has_evidence) AS with_evidence FROM r GROUP BY ALL",
    "j11_reconcile": "SELECT doc_id AS key, CASE WHEN doc_id % 10 = 0 AND toxic = 1 THEN 5 WHEN toxic = 1 THEN NULL ELSE quality END AS score, CASE WHEN doc_id % 10 <> 0 THEN 'kept' WHEN toxic = 1 THEN 'recovered' ELSE 'conflict' END AS status FROM labels",
    "a21_fingerprint": """SELECT sha256(string_agg(sha256('{"item_id":' || item_id || ',"text":' || to_json(text) || '}'), chr(10) ORDER BY item_id)) AS fingerprint, count(*) AS rows FROM benchmark""",
    "a25_release_gates": "WITH d AS (SELECT count(*) AS n, sum(toxic) AS toxic, sum(quality) AS good FROM labels) SELECT 'has_rows' AS gate, CASE WHEN n > 0 THEN 'pass' ELSE 'fail' END AS status FROM d UNION ALL SELECT 'few_toxic', CASE WHEN toxic * 2 < n THEN 'pass' ELSE 'fail' END FROM d UNION ALL SELECT 'all_good', CASE WHEN good = n THEN 'pass' ELSE 'fail' END FROM d",
}
