"""Index, search, fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import prepared_query, tokens
from ..functions.vectors import dot, is_unit, norm
from ..operators import retrieval as R
from .tables import SQL_BM25, SQL_DENSE, SQL_TOKENS, chunks, questions, vector_questions, vectors

TOP, DEPTH = 10, 100


def p01_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = chunks(spark, sf_dir).select("chunk_id", tokens(F.col("text")).alias("t"))
    return t.select("chunk_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("tokens_sha256"))


def a01_term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.postings(chunks(spark, sf_dir)).select("term", "chunk", F.col("dl").cast("long").alias("dl"), "tf")


def a02_term_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    return R.term_stats(R.document_frequency(c), R.corpus_stats(c)).select("term", "df", F.round("idf", 6).alias("idf"))


def a03_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    terms = R.term_rows(c, "chunk_id", "text").agg(F.count_distinct("term").alias("vocabulary"))
    return R.corpus_stats(c).crossJoin(terms).select("n", F.round("avgdl", 6).alias("avgdl"), F.col("min_dl").cast("long").alias("min_dl"), F.col("max_dl").cast("long").alias("max_dl"), "vocabulary")


def j01_bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25_scores(chunks(spark, sf_dir), questions(spark, sf_dir)).groupBy("query").agg(F.count("*").alias("found"), F.max("score").alias("best"), F.round(F.sum("score"), 2).alias("total"))


def w01_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25_search(chunks(spark, sf_dir), questions(spark, sf_dir), TOP).select("query", "chunk", "score", "rank")


def f02_bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only English chunks can be found; the statistics stay those of all."""
    return R.bm25_search(chunks(spark, sf_dir), questions(spark, sf_dir), TOP, allowed=F.col("domain") == "en").select("query", "chunk", "score", "rank")


def _dense(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    v = vectors(spark, sf_dir)
    return R.dense_search(v, v.where(F.col("vec_id") % 100 == 0), k, exclude_self=True)


def w02_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, TOP).select("query", "chunk", "score", "rank")


def f02_dense_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered before ranking."""
    v = vectors(spark, sf_dir)
    return R.dense_search(v.where("label < 5"), v.where(F.col("vec_id") % 100 == 0), TOP, exclude_self=True).select("query", "chunk", "score", "rank")


def p35_vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return v.select("vec_id", F.round(norm(F.col("embedding")), 6).alias("norm"), is_unit(F.col("embedding")).alias("unit"), F.round(dot(F.col("embedding"), F.col("embedding")), 6).alias("square"))


def p34_prepared_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("query_id", prepared_query(F.col("text"), "query: ").alias("prepared"))


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second ranking of the same questions and chunks: by label distance, then id."""
    q = vector_questions(spark, sf_dir).select(F.col("question").alias("q"), F.col("label").alias("topic"))
    return R.near_search(vectors(spark, sf_dir).select(F.col("vec_id").alias("chunk"), F.col("label").alias("topic")), q, DEPTH)


def j03_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.candidates(_dense(spark, sf_dir, DEPTH), _sparse(spark, sf_dir)).select("query", "chunk", "dense_rank", "bm25_rank", "dense_score", "bm25_score")


def w03_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = R.candidates(_dense(spark, sf_dir, DEPTH), _sparse(spark, sf_dir))
    return R.fuse(both, TOP, 20, 1.0, 0.1).select("query", "chunk", "fusion_score", "rank")


def w04_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reranker's score here is a function of the pair."""
    both = R.candidates(_dense(spark, sf_dir, DEPTH), _sparse(spark, sf_dir))
    fused = R.fuse(both, 20, 20, 1.0, 0.1)
    scores = fused.select("query", "chunk", ((F.col("chunk") * 7 + F.col("query")) % 5).cast("double").alias("reranker_score"))
    return R.rerank(fused, scores, TOP).select("query", "chunk", "reranker_score", "hybrid_rank", "rank")


def w30_top1_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.bm25_search(chunks(spark, sf_dir), questions(spark, sf_dir), 1)
    return questions(spark, sf_dir).join(found, F.col("query_id") == F.col("query"), "left").select("query_id", F.coalesce("score", F.lit(0.0)).alias("confidence"))


def w28_row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense row number over the total order (document, chunk): counts per document first, so no global sort in one task."""
    c = chunks(spark, sf_dir)
    before = c.groupBy("document_id").agg(F.count("*").alias("n")).select("document_id", (F.sum("n").over(Window.orderBy("document_id")) - F.col("n")).alias("before"))
    inner = F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_id"))
    return c.join(before, "document_id").select("chunk_id", "document_id", (F.col("before") + inner - 1).alias("row_index"))


QUERIES = {f.__name__: f for f in (p01_tokens, a01_term_frequency, a02_term_idf, a03_corpus_stats, j01_bm25_scores, w01_bm25_topk, f02_bm25_filtered, w02_dense_topk, f02_dense_filtered, p35_vector_norms, p34_prepared_queries, j03_candidates, w03_rrf, w04_rerank, w30_top1_confidence, w28_row_index)}

SQL_SPARSE = """
sparse_pairs AS (
  SELECT q.vec_id AS question, v.vec_id AS chunk, round(1 / (1 + abs(q.vec_id - v.vec_id)), 6) AS score
  FROM embeddings q JOIN embeddings v USING (label) WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
sparse AS (
  SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, chunk) AS rank FROM sparse_pairs
  QUALIFY row_number() OVER (PARTITION BY question ORDER BY score DESC, chunk) <= 100),
both_ AS (
  SELECT coalesce(d.question, s.question) AS query, coalesce(d.chunk, s.chunk) AS chunk, d.rank AS dense_rank, d.score AS dense_score, s.rank AS bm25_rank, s.score AS bm25_score
  FROM dense d FULL OUTER JOIN sparse s ON d.question = s.question AND d.chunk = s.chunk),
fused AS (
  SELECT *, round(coalesce(1.0::DOUBLE / (20 + dense_rank), 0) + coalesce(0.1::DOUBLE / (20 + bm25_rank), 0), 9) AS fusion_score FROM both_),
ranked AS (
  SELECT query, chunk, fusion_score, row_number() OVER (PARTITION BY query ORDER BY fusion_score DESC, least(coalesce(dense_rank, 1000000000), coalesce(bm25_rank, 1000000000)), chunk) AS rank FROM fused)"""

SQL = {
    "p01_tokens": f"WITH {SQL_TOKENS} SELECT chunk AS chunk_id, len(t) AS n_tokens, sha256(array_to_string(t, ' ')) AS tokens_sha256 FROM toks",
    "a01_term_frequency": f"WITH {SQL_TOKENS} SELECT term, chunk, dl, tf FROM post",
    "a02_term_idf": f"WITH {SQL_TOKENS} SELECT term, df, round(idf, 6) AS idf FROM terms",
    "a03_corpus_stats": f"WITH {SQL_TOKENS} SELECT n, round(avgdl, 6) AS avgdl, min_dl, max_dl, (SELECT count(*) FROM terms) AS vocabulary FROM stats",
    "j01_bm25_scores": f"WITH {SQL_BM25} SELECT query, count(*) AS found, max(score) AS best, round(sum(score), 2) AS total FROM bm25_scores GROUP BY query",
    "w01_bm25_topk": f"WITH {SQL_BM25} SELECT query, chunk, score, row_number() OVER w AS rank FROM bm25_scores WINDOW w AS (PARTITION BY query ORDER BY score DESC, chunk) QUALIFY row_number() OVER w <= 10",
    "f02_bm25_filtered": f"WITH {SQL_BM25} SELECT query, chunk, score, row_number() OVER w AS rank FROM bm25_scores WHERE lang = 'en' WINDOW w AS (PARTITION BY query ORDER BY score DESC, chunk) QUALIFY row_number() OVER w <= 10",
    "w02_dense_topk": f"WITH {SQL_DENSE} SELECT question AS query, chunk, score, rank FROM dense WHERE rank <= 10",
    "f02_dense_filtered": f"WITH {SQL_DENSE} SELECT question AS query, chunk, score, row_number() OVER w AS rank FROM dense_pairs JOIN embeddings e ON e.vec_id = chunk WHERE label < 5 WINDOW w AS (PARTITION BY question ORDER BY score DESC, chunk) QUALIFY row_number() OVER w <= 10",
    "p35_vector_norms": "SELECT vec_id, round(sqrt(s), 6) AS norm, abs(sqrt(s) - 1) <= 1e-4 AS unit, round(s, 6) AS square FROM (SELECT vec_id, list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS s FROM embeddings)",
    "p34_prepared_queries": r"SELECT item_id AS query_id, 'query: ' || trim(regexp_replace(text, '\s+', ' ', 'g')) AS prepared FROM benchmark",
    "j03_candidates": f"WITH {SQL_DENSE}, {SQL_SPARSE} SELECT query, chunk, dense_rank, bm25_rank, dense_score, bm25_score FROM both_",
    "w03_rrf": f"WITH {SQL_DENSE}, {SQL_SPARSE} SELECT * FROM ranked WHERE rank <= 10",
    "w04_rerank": f"""WITH {SQL_DENSE}, {SQL_SPARSE} SELECT * FROM (
      SELECT query, chunk, CAST((chunk * 7 + query) % 5 AS DOUBLE) AS reranker_score, rank AS hybrid_rank,
             row_number() OVER (PARTITION BY query ORDER BY (chunk * 7 + query) % 5 DESC, rank, chunk) AS rank FROM ranked WHERE rank <= 20) WHERE rank <= 10""",
    "w30_top1_confidence": f"WITH {SQL_BM25} SELECT item_id AS query_id, coalesce(max(score), 0) AS confidence FROM benchmark LEFT JOIN bm25_scores ON query = item_id GROUP BY item_id",
    "w28_row_index": "SELECT doc_id AS chunk_id, source AS document_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS row_index FROM documents",
}
