"""Retrieval evaluation, thresholds, sweeps, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import retrieval as R
from .retrieval import SQL_SPARSE, _dense, _sparse
from .tables import SQL_DENSE, SQL_QUESTIONS, judgment_counts, pair_judgments, read, vector_judgments, vector_questions, vectors

RANKED = 20


def _rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, RANKED).select(F.col("query").alias("question"), "chunk", "rank")


def _per_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, found = vector_questions(spark, sf_dir).drop("label"), _rankings(spark, sf_dir)
    return M.question_metrics(q, found, pair_judgments(spark, sf_dir, found), judgment_counts(spark, sf_dir))


def w06_question_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6-W9 with J4."""
    return _per_question(spark, sf_dir).select("question", F.col("first_relevant_rank"), *M.METRICS)


def a09_mean_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _per_question(spark, sf_dir)
    return p.agg(*M.mean_metrics(p))


def a12_grouped_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.grouped_metrics(_per_question(spark, sf_dir))


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select(F.col("vec_id").alias("chunk"), F.floor(F.col("vec_id") / 3).alias("section"))


def w10_section_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W10 with J8 and A20."""
    q = vector_questions(spark, sf_dir).drop("label")
    found = M.section_rankings(_rankings(spark, sf_dir), _sections(spark, sf_dir))
    judged = pair_judgments(spark, sf_dir, found, "section")
    return M.question_metrics(q, found, judged, judgment_counts(spark, sf_dir, "section")).select("question", F.col("first_relevant_rank"), *M.METRICS)


def j05_missing_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments against an index that lacks the chunks divisible by 7."""
    index = vectors(spark, sf_dir).where("vec_id % 7 <> 0").select(F.col("vec_id").alias("chunk"))
    return M.missing_judgments(vector_judgments(spark, sf_dir), index).select("question", "chunk", "grade")


def j13_retrieved_relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with at least one relevant chunk among the retrieved."""
    hits = pair_judgments(spark, sf_dir, _rankings(spark, sf_dir))
    return vector_questions(spark, sf_dir).join(hits, "question", "left_semi").select("question")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label quality as the class, text length in words as the score."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", (F.col("quality") == 1).alias("positive"), F.floor(F.col("n_chars") / 50).cast("double").alias("score"), (F.col("doc_id") % 5 < 3).alias("dev"))


def a10_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of pairs in order, ties half."""
    return M.auroc(_scores(spark, sf_dir))


def w15_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.thresholds(_scores(spark, sf_dir))


def a11_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scores(spark, sf_dir)
    return M.confusion(s, M.thresholds(s))


def w16_selected_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: chosen on the dev rows, applied to the others."""
    s = _scores(spark, sf_dir)
    dev, test = s.where("dev"), s.where("NOT dev")
    best = M.select_threshold(M.confusion(dev, M.thresholds(dev))).select("threshold")
    names = ("threshold", "tp", "fn", "tn", "fp", "recall", "rejection", "balanced_accuracy")
    return M.confusion(test, best).select(*names)


def a07_score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.score_summary(read(spark, sf_dir, "documents"), "n_chars", ("lang",))


def w17_fusion_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both rankings are made once and fused under each of the 63 settings."""
    both = R.candidates(_dense(spark, sf_dir, 100), _sparse(spark, sf_dir))
    grid = F.broadcast(M.fusion_grid(spark))  # 63 rows
    setting = ("bm25_weight", "rrf_k", "candidate_k")
    pairs = both.select(F.col("query").alias("question"), "chunk")
    graded = both.join(pair_judgments(spark, sf_dir, pairs).withColumnRenamed("question", "query"), ["query", "chunk"], "left")
    hits = R.fuse_each(graded, grid, 10).where("grade IS NOT NULL").groupBy(*setting, F.col("query").alias("question")).agg(
        F.min("rank").alias("first"), *[F.sum(F.when(F.col("rank") <= k, M.gain(F.col("grade")) / M.discount(F.col("rank")))).alias(f"dcg{k}") for k in M.CUTS], F.count("*").alias("hits")
    )
    asked = vector_questions(spark, sf_dir).where("answerable").select("question").crossJoin(grid)
    table = asked.join(hits, [*setting, "question"], "left").join(M.ideal_of_counts(judgment_counts(spark, sf_dir)), "question", "left")
    mean = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 6)
    means = table.groupBy(*setting).agg(mean(F.col("hits") / F.col("n_rel")).alias("recall10"), mean(1 / F.col("first")).alias("rr"), mean(F.col("dcg5") / F.col("idcg5")).alias("ndcg5"), mean(F.col("dcg10") / F.col("idcg10")).alias("ndcg10"))
    base = means.where("bm25_weight = 0").agg(F.max("recall10").alias("base"))
    return M.rank_settings(means.crossJoin(F.broadcast(base)), F.col("base") - M.RECALL_ALLOWANCE).drop("base")  # base is one row


def c24_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean metrics against frozen ones that partly lie above."""
    p = _per_question(spark, sf_dir)
    m = p.agg(*M.mean_metrics(p)).select(F.expr("stack(3, 'recall10', recall10, 'rr', rr, 'ndcg10', ndcg10) AS (metric, value)"))
    frozen = spark.createDataFrame([("recall10", 0.0, 0.01), ("rr", 1.5, 0.015), ("ndcg10", 1.0, 0.01), ("map", 0.5, 0.01)], "metric string, frozen double, tolerance double")
    return M.gate(m, frozen)


QUERIES = {
    f.__name__: f
    for f in (w06_question_metrics, a09_mean_metrics, a12_grouped_metrics, w10_section_metrics, j05_missing_judgments, j13_retrieved_relevant, a10_auroc, w15_thresholds, a11_confusion, w16_selected_threshold, a07_score_summary, w17_fusion_sweep, c24_gate)
}

_METRICS = """
ideal_rows AS (SELECT question, grade, row_number() OVER (PARTITION BY question ORDER BY grade DESC, chunk) AS r FROM {j} WHERE grade > 0),
ideal AS (SELECT question, count(*) AS n_rel, sum(CASE WHEN r <= 5 THEN (2.0 ** grade - 1) / log2(r + 1) END) AS idcg5, sum(CASE WHEN r <= 10 THEN (2.0 ** grade - 1) / log2(r + 1) END) AS idcg10 FROM ideal_rows GROUP BY question),
hits AS (
  SELECT question, min(rank) AS first_relevant_rank, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS h10,
         sum(CASE WHEN rank <= 5 THEN (2.0 ** grade - 1) / log2(rank + 1) END) AS dcg5, sum(CASE WHEN rank <= 10 THEN (2.0 ** grade - 1) / log2(rank + 1) END) AS dcg10
  FROM {r} JOIN {j} USING (question, chunk) WHERE grade > 0 GROUP BY question),
per_question AS (
  SELECT q.question, category, difficulty, split, answerable, first_relevant_rank,
         CASE WHEN answerable THEN round(coalesce(1.0::DOUBLE / first_relevant_rank, 0), 6) END AS rr,
         CASE WHEN answerable THEN coalesce(CAST(first_relevant_rank = 1 AS DOUBLE), 0) END AS top1,
         CASE WHEN answerable THEN round(coalesce(h5 / n_rel, 0), 6) END AS recall5, CASE WHEN answerable THEN round(coalesce(dcg5 / idcg5, 0), 6) END AS ndcg5,
         CASE WHEN answerable THEN round(coalesce(h10 / n_rel, 0), 6) END AS recall10, CASE WHEN answerable THEN round(coalesce(dcg10 / idcg10, 0), 6) END AS ndcg10
  FROM questions q LEFT JOIN hits USING (question) LEFT JOIN ideal USING (question))"""
_CHUNKS = f"{SQL_QUESTIONS}, {SQL_DENSE}, rankings AS (SELECT question, chunk, rank FROM dense WHERE rank <= 20), {_METRICS.format(r='rankings', j='judgments')}"
_MEANS = "count(*) AS questions, CAST(sum(CAST(answerable AS INTEGER)) AS BIGINT) AS answerable_questions, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in M.METRICS)
_SCORES = "scores AS (SELECT doc_id, quality = 1 AS positive, CAST(n_chars // 50 AS DOUBLE) AS score FROM documents JOIN labels USING (doc_id))"
_CUTS = """
d AS (SELECT DISTINCT score FROM {s}),
cuts AS (
  SELECT (score + nxt) / 2 AS threshold FROM (SELECT score, lead(score) OVER (ORDER BY score) AS nxt FROM d) WHERE nxt IS NOT NULL
  UNION ALL SELECT min(score) - 1e-12::DOUBLE FROM d UNION ALL SELECT max(score) + 1e-12::DOUBLE FROM d)"""
_CONFUSION = """
SELECT threshold, tp, fn, tn, fp, round(coalesce(tp / (tp + fn), 0), 6) AS recall, round(coalesce(tn / (tn + fp), 0), 6) AS rejection,
       round((coalesce(tp / (tp + fn), 0) + coalesce(tn / (tn + fp), 0)) / 2, 6) AS balanced_accuracy
FROM (SELECT threshold, count(*) FILTER (positive AND score >= threshold) AS tp, count(*) FILTER (positive AND score < threshold) AS fn,
             count(*) FILTER (NOT positive AND score < threshold) AS tn, count(*) FILTER (NOT positive AND score >= threshold) AS fp
      FROM {c}, {s} GROUP BY threshold)"""

SQL = {
    "w06_question_metrics": f"WITH {_CHUNKS} SELECT question, first_relevant_rank, rr, top1, recall5, ndcg5, recall10, ndcg10 FROM per_question",
    "a09_mean_metrics": f"WITH {_CHUNKS} SELECT {_MEANS} FROM per_question",
    "a12_grouped_metrics": f"""WITH {_CHUNKS}
SELECT CASE grouping(category, difficulty, split) WHEN 7 THEN 'overall' WHEN 3 THEN 'category' WHEN 5 THEN 'difficulty' ELSE 'split' END AS grouping,
       coalesce(category, difficulty, split, 'all') AS value, {_MEANS} FROM per_question GROUP BY GROUPING SETS ((), (category), (difficulty), (split))""",
    "w10_section_metrics": f"""WITH {SQL_QUESTIONS}, {SQL_DENSE},
section_rank AS (SELECT question, chunk // 3 AS chunk, min(rank) AS rank FROM dense WHERE rank <= 20 GROUP BY ALL),
section_grade AS (SELECT question, chunk // 3 AS chunk, max(grade) AS grade FROM judgments GROUP BY ALL),
{_METRICS.format(r='section_rank', j='section_grade')}
SELECT question, first_relevant_rank, rr, top1, recall5, ndcg5, recall10, ndcg10 FROM per_question""",
    "j05_missing_judgments": f"WITH {SQL_QUESTIONS} SELECT question, chunk, grade FROM judgments WHERE chunk % 7 = 0",
    "j13_retrieved_relevant": f"WITH {_CHUNKS} SELECT DISTINCT question FROM rankings JOIN judgments USING (question, chunk)",
    "a10_auroc": f"WITH {_SCORES} SELECT round(avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END), 6) AS auroc FROM scores p, scores n WHERE p.positive AND NOT n.positive",
    "w15_thresholds": f"WITH {_SCORES}, {_CUTS.format(s='scores')} SELECT threshold FROM cuts",
    "a11_confusion": f"WITH {_SCORES}, {_CUTS.format(s='scores')} {_CONFUSION.format(c='cuts', s='scores')}",
    "w16_selected_threshold": f"""WITH {_SCORES}, dev AS (SELECT * FROM scores WHERE doc_id % 5 < 3), test AS (SELECT * FROM scores WHERE doc_id % 5 >= 3),
{_CUTS.format(s='dev')}, dev_table AS ({_CONFUSION.format(c='cuts', s='dev')}),
best AS (SELECT threshold FROM dev_table ORDER BY balanced_accuracy DESC, rejection DESC, recall DESC, threshold DESC LIMIT 1)
{_CONFUSION.format(c='best', s='test')}""",
    "a07_score_summary": "SELECT lang, count(n_chars) AS n, min(n_chars) AS least, max(n_chars) AS greatest, round(avg(n_chars), 3) AS mean, round(median(n_chars), 3) AS median, round(quantile_cont(n_chars, 0.9), 3) AS p90, round(quantile_cont(n_chars, 0.95), 3) AS p95 FROM documents GROUP BY lang",
    "w17_fusion_sweep": f"""WITH {SQL_QUESTIONS}, {SQL_DENSE}, {SQL_SPARSE},
grid AS (SELECT w::DOUBLE AS bm25_weight, r::INTEGER AS rrf_k, c::INTEGER AS candidate_k FROM unnest([0, 0.1, 0.2, 0.35, 0.5, 0.75, 1]) a(w), unnest([20, 60, 100]) b(r), unnest([20, 50, 100]) e(c)),
cut AS (SELECT bm25_weight, rrf_k, candidate_k, query AS question, chunk, CASE WHEN dense_rank <= candidate_k THEN dense_rank END AS dr, CASE WHEN bm25_rank <= candidate_k THEN bm25_rank END AS br FROM both_, grid),
scored AS (SELECT *, round(coalesce(1.0::DOUBLE / (rrf_k + dr), 0) + coalesce(bm25_weight / (rrf_k + br), 0), 9) AS s FROM cut WHERE dr IS NOT NULL OR br IS NOT NULL),
top AS (SELECT *, row_number() OVER (PARTITION BY bm25_weight, rrf_k, candidate_k, question ORDER BY s DESC, least(coalesce(dr, 1000000000), coalesce(br, 1000000000)), chunk) AS rank FROM scored
        QUALIFY row_number() OVER (PARTITION BY bm25_weight, rrf_k, candidate_k, question ORDER BY s DESC, least(coalesce(dr, 1000000000), coalesce(br, 1000000000)), chunk) <= 10),
hits AS (SELECT bm25_weight, rrf_k, candidate_k, question, min(rank) AS first, count(*) AS h, sum(CASE WHEN rank <= 5 THEN (2.0 ** grade - 1) / log2(rank + 1) END) AS dcg5, sum((2.0 ** grade - 1) / log2(rank + 1)) AS dcg10 FROM top JOIN judgments USING (question, chunk) GROUP BY ALL),
ideal_rows AS (SELECT question, grade, row_number() OVER (PARTITION BY question ORDER BY grade DESC, chunk) AS r FROM judgments),
ideal AS (SELECT question, count(*) AS n_rel, sum(CASE WHEN r <= 5 THEN (2.0 ** grade - 1) / log2(r + 1) END) AS idcg5, sum(CASE WHEN r <= 10 THEN (2.0 ** grade - 1) / log2(r + 1) END) AS idcg10 FROM ideal_rows GROUP BY question),
means AS (
  SELECT g.bm25_weight, g.rrf_k, g.candidate_k, round(avg(coalesce(h / n_rel, 0)), 6) AS recall10, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS rr, round(avg(coalesce(dcg5 / idcg5, 0)), 6) AS ndcg5, round(avg(coalesce(dcg10 / idcg10, 0)), 6) AS ndcg10
  FROM (SELECT * FROM questions, grid WHERE answerable) g LEFT JOIN hits USING (bm25_weight, rrf_k, candidate_k, question) LEFT JOIN ideal USING (question) GROUP BY ALL),
marked AS (SELECT *, recall10 >= (SELECT max(recall10) FROM means WHERE bm25_weight = 0) - 0.01::DOUBLE AS eligible FROM means)
SELECT *, row_number() OVER (ORDER BY eligible DESC, ndcg10 DESC, rr DESC, ndcg5 DESC, recall10 DESC, bm25_weight, rrf_k, candidate_k) AS place FROM marked""",
    "c24_gate": f"""WITH {_CHUNKS}, m AS (SELECT {_MEANS} FROM per_question),
measured AS (SELECT 'recall10' AS metric, recall10 AS value FROM m UNION ALL SELECT 'rr', rr FROM m UNION ALL SELECT 'ndcg10', ndcg10 FROM m),
frozen AS (SELECT * FROM (VALUES ('recall10', 0.0::DOUBLE, 0.01::DOUBLE), ('rr', 1.5, 0.015), ('ndcg10', 1.0, 0.01), ('map', 0.5, 0.01)) t(metric, frozen, tolerance))
SELECT metric, frozen, tolerance, value FROM frozen LEFT JOIN measured USING (metric) WHERE value IS NULL OR value < frozen - tolerance - 1e-9""",
}
