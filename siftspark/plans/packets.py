"""Labelling packs, evidence packets and scored reviews over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import packets as K
from ..operators import planning as P
from ..operators import retrieval as R
from .evidence import SQL as EVIDENCE_SQL
from .evidence import w20_snippets
from .planning import _CELLS, _REVIEW, _reviews
from .tables import read, vectors

#: The seed questions of the test, by the key of a region.
SEEDS = (
    "CASE r_regionkey % 2 WHEN 0 THEN 'comparison' ELSE 'multi_hop' END AS category",
    "'medium' AS difficulty",
    "CASE WHEN r_regionkey < 3 THEN 'dev' ELSE 'test' END AS split",
)


def c15_labelling_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions are the seeds (numbers 1 to 5), vectors the chunks: label the domain, id divided by 3 the document; W22 to W27
    make slots, numbers, anchors and neighbours."""
    seeds = read(spark, sf_dir, "region").selectExpr("r_regionkey + 1 AS number", *SEEDS)
    slots = P.interleave(P.residual_slots(P.quota_cells(spark), seeds)).select("turn", "category", "difficulty", "split")
    v = vectors(spark, sf_dir)
    sized = v.select("vec_id", "label", (F.col("vec_id") * 7 % 311).alias("token_count"))
    anchors = P.balanced_anchors(sized, P.TOTAL, "label", "vec_id").withColumn("at", F.struct("place", "label")).select(F.col("at").alias("place"), F.col("vec_id").alias("chunk"))
    asked = v.join(F.broadcast(anchors.select(F.col("chunk").alias("vec_id"))), "vec_id", "left_semi")  # at most TOTAL rows
    found = R.dense_search(v, asked, P.NEIGHBOURS, exclude_self=True).select(F.col("query").alias("anchor"), "chunk", "score")
    chunks = v.select(F.col("vec_id").alias("chunk"), F.col("label").alias("domain"), F.floor(F.col("vec_id") / 3).alias("document"))
    packs = K.labelling_packs(slots, P.free_numbers(seeds, "number", P.TOTAL), anchors, found, chunks, seeds.withColumn("question_id", F.concat(F.lit("q-"), F.lpad(F.col("number").cast("string"), 3, "0"))))
    listed = F.array_join(F.transform("related", lambda r: r["context"]["chunk"].cast("string")), ",")
    return packs.select("question_id", "status", "category", "difficulty", "split", "answerable", F.col("anchor_context.chunk").alias("anchor"), listed.alias("related"))


def c21_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A packet for every source and every conversation role as questions; only sources have snippets."""
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("question"), F.lit("what is told").alias("text"))
    roles = read(spark, sf_dir, "conversations").select(F.col("role").alias("question"), F.lit("who is told").alias("text"))
    packets = K.evidence_packets(d.union(roles).distinct(), w20_snippets(spark, sf_dir))
    return packets.select("question", "text", "evidence_status", "evidence_ids", F.coalesce(F.array_join(F.transform("evidence", lambda e: e["chunk"].cast("string")), ","), F.lit("")).alias("chunks"))


def c21_review_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), (F.col("quality") == 1).alias("answerable"))
    return K.review_scores(_reviews(spark, sf_dir)[1], gold)


QUERIES = {f.__name__: f for f in (c15_labelling_packs, c21_packets, c21_review_scores)}

_SEEDS = f"s AS (SELECT r_regionkey + 1 AS number, {', '.join(SEEDS)} FROM region)"
SQL = {
    "c15_labelling_packs": f"""WITH {_SEEDS}, {_CELLS},
have AS (SELECT category, axis, value, count(*) AS have FROM (SELECT category, 'difficulty' AS axis, difficulty AS value FROM s UNION ALL SELECT category, 'split', split FROM s) GROUP BY ALL),
left_ AS (SELECT category, category_index, axis, value, value_index, greatest(target - coalesce(have, 0), 0) AS n FROM cells LEFT JOIN have USING (category, axis, value)),
laid AS (SELECT *, row_number() OVER (PARTITION BY category, axis ORDER BY value_index, i) - 1 AS position, count(*) OVER (PARTITION BY category, axis) AS size FROM (SELECT *, unnest(range(n)) AS i FROM left_)),
turned AS (SELECT *, CASE WHEN axis = 'split' THEN (position - size // 3 + size) % size ELSE position END AS p FROM laid),
slots AS (SELECT row_number() OVER (ORDER BY d.p, d.category_index) AS turn, d.category, d.value AS difficulty, e.value AS split FROM turned d JOIN turned e ON d.category = e.category AND d.p = e.p WHERE d.axis = 'difficulty' AND e.axis = 'split'),
free AS (SELECT n AS number, row_number() OVER (ORDER BY n) AS turn FROM range(1, 101) t(n) WHERE n NOT IN (SELECT number FROM s)),
placed AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id * 7 % 311 < 64, abs(vec_id * 7 % 311 - 180), vec_id) AS place FROM embeddings),
anchors AS (SELECT vec_id AS anchor, row_number() OVER (ORDER BY place, label) AS turn FROM placed QUALIFY turn <= 100),
near AS (
  SELECT a.anchor, a.turn, q.label AS ql, v.vec_id AS chunk, v.label AS vl, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
  FROM anchors a JOIN embeddings q ON q.vec_id = a.anchor JOIN embeddings v ON v.vec_id <> a.anchor QUALIFY row_number() OVER (PARTITION BY a.anchor ORDER BY score DESC, v.vec_id) <= 30),
tiered AS (
  SELECT slots.turn, category, chunk, score, CASE category WHEN 'comparison' THEN CASE WHEN ql <> vl THEN 3 WHEN anchor // 3 <> chunk // 3 THEN 1 ELSE 2 END WHEN 'multi_hop' THEN CASE WHEN ql <> vl THEN 2 WHEN anchor // 3 <> chunk // 3 THEN 1 ELSE 3 END
    ELSE CASE WHEN ql = vl THEN 1 ELSE 2 END END AS tier FROM slots JOIN near USING (turn)),
kept AS (SELECT *, row_number() OVER (PARTITION BY turn ORDER BY tier, score DESC, chunk) AS k FROM tiered QUALIFY k <= CASE WHEN category IN ('direct_factual', 'scenario_application') THEN 3 ELSE 4 END),
lists AS (SELECT turn, string_agg(CAST(chunk AS VARCHAR), ',' ORDER BY k) AS related FROM kept GROUP BY turn)
SELECT 'q-' || lpad(CAST(number AS VARCHAR), 3, '0') AS question_id, 'needs_labeling' AS status, category, difficulty, split, category <> 'negative_near_miss' AS answerable, anchor, related
FROM slots JOIN free USING (turn) JOIN anchors USING (turn) LEFT JOIN lists USING (turn)
UNION ALL SELECT 'q-' || lpad(CAST(number AS VARCHAR), 3, '0'), 'seed_complete', category, difficulty, split, category <> 'negative_near_miss', NULL, NULL FROM s""",
    "c21_packets": f"""WITH snippets AS ({EVIDENCE_SQL['w20_snippets']}),
asked AS (SELECT DISTINCT source AS question, 'what is told' AS text FROM documents UNION SELECT DISTINCT role, 'who is told' FROM conversations),
lists AS (SELECT question, string_agg(evidence_id, '; ' ORDER BY CAST(evidence_id[2:] AS INTEGER)) AS ids, string_agg(CAST(chunk AS VARCHAR), ',' ORDER BY CAST(evidence_id[2:] AS INTEGER)) AS chunks FROM snippets GROUP BY question)
SELECT question, text, CASE WHEN ids IS NULL THEN 'missing_saved_retrieval' ELSE 'evidence_available' END AS evidence_status, coalesce(ids, '') AS evidence_ids, coalesce(chunks, '') AS chunks FROM asked LEFT JOIN lists USING (question)""",
    "c21_review_scores": f"""WITH {_REVIEW}, j AS (SELECT nullif(relation, '') AS said, quality = 1 AS yes FROM r LEFT JOIN labels ON doc_id = key)
SELECT count(*) AS questions, count(said) AS reviewed, count(*) - count(said) AS unreviewed, count(*) = count(said) AS all_reviewed, count(*) FILTER (yes AND said IS NOT NULL) AS positive_reviewed, count(*) FILTER (NOT yes AND said IS NOT NULL) AS negative_reviewed,
       count(*) FILTER (yes AND said = 'supported') AS positive_supported, count(*) FILTER (yes AND said = 'partial') AS positive_partial, count(*) FILTER (NOT yes AND said = 'contradicted') AS negative_contradicted,
       count(*) FILTER (NOT yes AND said = 'insufficient') AS negative_insufficient, count(*) FILTER (NOT yes AND said = 'supported') AS negative_supported FROM j""",
}
