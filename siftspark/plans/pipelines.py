"""Composite pipelines: building indexes, searching them, running experiments and gates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.chunking import ChunkSettings
from ..functions.embedding import embed, hashing_embedder
from ..functions.vectors import is_unit
from ..functions.text import prepared_query
from ..operators import checks as K
from ..operators import corpus as C
from ..operators import evidence as E
from ..operators import metrics as M
from ..operators import retrieval as R
from ..operators import validation as V
from ..sources.chat import complete
from ..sources.files import settings_hash

#: Chunk sizes of the experiment (target, overlap) and the frozen search settings.
VARIANTS = ((256, 32), (512, 64), (1024, 128))
SYSTEM = "Answer from the given evidence alone. Reply with JSON: abstain (true or false), answer, citations (evidence ids). Mark each claim with [id]; abstain if the evidence does not settle the question."
VERIFIER = "Judge the answer by the evidence alone. Reply with JSON: verdict (supported, unsupported, contradicted or uncertain) and quotes (verbatim from the evidence)."
FROZEN = {"candidate_k": 20, "rrf_k": 20, "dense_weight": 1.0, "bm25_weight": 0.1}


def prepare_corpus(chunks: DataFrame) -> DataFrame:
    """Checks, then the indexable chunks with retrieval text."""
    C.fail_closed(C.all_violations(
        C.violation(chunks, "empty_text", F.col("chunk_id"), F.trim(F.coalesce("text", F.lit(""))) == ""),
        C.violation(chunks.groupBy("chunk_id").count(), "repeated_id", F.col("chunk_id"), F.col("count") > 1),
    ))
    return C.prepare_chunks(chunks).where("indexable")


def build_bm25_index(chunks: DataFrame, path: str, id_col: str = "chunk_id", text_col: str = "retrieval_text", k1: float = R.K1, b: float = R.B) -> None:
    """Postings (clustered by term), terms and statistics as Parquet, and a manifest row."""
    R.check_bm25(k1, b, 1)
    spark = chunks.sparkSession
    R.postings(chunks, id_col, text_col).repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    R.corpus_stats(chunks, text_col).write.mode("overwrite").parquet(f"{path}/stats")
    post = spark.read.parquet(f"{path}/postings")
    R.term_stats(post.groupBy("term").agg(F.count("*").alias("df")), spark.read.parquet(f"{path}/stats")).write.mode("overwrite").parquet(f"{path}/terms")
    facts = chunks.agg(F.count("*").alias("chunks"), F.sum(F.xxhash64(id_col, text_col).cast("decimal(38,0)")).cast("string").alias("content"))
    facts.withColumns({"k1": F.lit(k1), "b": F.lit(b), "settings": F.lit(settings_hash({"k1": k1, "b": b}))}).write.mode("overwrite").json(f"{path}/manifest")


def check_bm25_index(spark: SparkSession, path: str, chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "retrieval_text") -> None:
    """the index is of exactly these chunks."""
    m = spark.read.json(f"{path}/manifest").first()
    now = chunks.agg(F.count("*").alias("chunks"), F.sum(F.xxhash64(id_col, text_col).cast("decimal(38,0)")).cast("string").alias("content")).first()
    if (m.chunks, m["content"] if "content" in m else None) != (now.chunks, now["content"]):
        raise ValueError("the index was built from other chunks")


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int, k1: float = R.K1, b: float = R.B, allowed: DataFrame | None = None) -> DataFrame:
    """Search the stored tables: the query terms' postings alone are read, statistics as stored."""
    R.check_bm25(k1, b, k)
    asked = R.query_terms(queries, "query_id", "text")
    post = spark.read.parquet(f"{path}/postings").join(asked, "term")
    if allowed is not None:
        post = post.join(allowed.select("chunk"), "chunk", "left_semi")
    stats = spark.read.parquet(f"{path}/stats").select("avgdl")  # one row
    w = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))) * F.col("times")
    scored = post.join(spark.read.parquet(f"{path}/terms").select("term", "idf"), "term").crossJoin(F.broadcast(stats)).groupBy("query", "chunk").agg(F.round(F.sum(w), R.DIGITS).alias("score"))
    return R.top_k(scored, k)


def build_dense_index(chunks: DataFrame, path: str, model: Callable = hashing_embedder, id_col: str = "chunk_id", text_col: str = "retrieval_text") -> None:
    """One unit vector per chunk; anything else is an error before the index counts as built."""
    chunks.select(F.col(id_col).alias("chunk"), embed(F.col(text_col), model).alias("v")).write.mode("overwrite").parquet(f"{path}/vectors")
    v = chunks.sparkSession.read.parquet(f"{path}/vectors")
    C.fail_closed(C.violation(v, "not_a_unit_vector", F.col("chunk"), ~is_unit(F.col("v"))))


@dataclass
class Bm25Retriever:
    """Lexical search over a folder of indexes."""

    spark: SparkSession
    path: str
    k1: float = R.K1
    b: float = R.B

    def describe(self) -> dict:
        s = self.spark.read.parquet(f"{self.path}/stats").first()
        return {"path": self.path, "k1": self.k1, "b": self.b, "chunks": s.n, "average_length": s.avgdl, "terms": self.spark.read.parquet(f"{self.path}/terms").count()}

    def search(self, queries: DataFrame, top_k: int = 10, metadata: DataFrame | None = None, domains: list[str] | None = None, document_ids: list[str] | None = None) -> DataFrame:
        return search_index(self.spark, self.path, queries, top_k, self.k1, self.b, _allowed(metadata, domains, document_ids))


@dataclass
class DenseRetriever:
    """Search by vectors over a folder of indexes. A query gets the prefix, if there is one, before it is embedded."""

    spark: SparkSession
    path: str
    model: Callable = hashing_embedder
    prefix: str = ""

    def describe(self) -> dict:
        v = self.spark.read.parquet(f"{self.path}/vectors").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w")).first()
        return {"path": self.path, "chunks": v.n, "width": v.w, "prefix": self.prefix}

    def search(self, queries: DataFrame, top_k: int = 10, metadata: DataFrame | None = None, domains: list[str] | None = None, document_ids: list[str] | None = None) -> DataFrame:
        if top_k <= 0:
            raise ValueError("top_k must be positive")
        allowed = _allowed(metadata, domains, document_ids)
        vectors = self.spark.read.parquet(f"{self.path}/vectors")
        vectors = vectors if allowed is None else vectors.join(allowed, "chunk", "left_semi")
        asked = queries.select("query_id", embed(prepared_query(F.col("text"), self.prefix), self.model).alias("qv"))
        return R.dense_search(vectors, asked, top_k, "chunk", "v", "query_id", "qv")


@dataclass
class HybridRetriever:
    """Both searches and their fusion, for tables of queries (query_id, text)."""

    spark: SparkSession
    path: str
    model: Callable = hashing_embedder
    candidate_k: int = FROZEN["candidate_k"]
    rrf_k: int = FROZEN["rrf_k"]
    dense_weight: float = FROZEN["dense_weight"]
    bm25_weight: float = FROZEN["bm25_weight"]

    def __post_init__(self):
        if self.candidate_k <= 0 or self.rrf_k <= 0 or min(self.dense_weight, self.bm25_weight) < 0 or self.dense_weight + self.bm25_weight == 0:
            raise ValueError("fusion needs positive depths and weights that are not both 0")

    def describe(self) -> dict:
        return {"path": self.path, "candidate_k": self.candidate_k, "rrf_k": self.rrf_k, "dense_weight": self.dense_weight, "bm25_weight": self.bm25_weight}

    def search(self, queries: DataFrame, top_k: int = 10, metadata: DataFrame | None = None, domains: list[str] | None = None, document_ids: list[str] | None = None) -> DataFrame:
        """query, chunk, rank and the parts of the score. Filters name domains and documents of ``metadata`` (chunk, domain,
        document_id); empty ones don't filter."""
        if top_k <= 0:
            raise ValueError("top_k must be positive")
        depth = max(self.candidate_k, top_k)
        named = (queries, depth, metadata, domains, document_ids)
        lexical, dense = Bm25Retriever(self.spark, self.path).search(*named), DenseRetriever(self.spark, self.path, self.model).search(*named)
        return R.fuse(R.candidates(dense, lexical), top_k, self.rrf_k, self.dense_weight, self.bm25_weight)


def _allowed(metadata: DataFrame | None, domains: list[str] | None, document_ids: list[str] | None) -> DataFrame | None:
    """names stripped, empty ones dropped; no names, no filter."""
    clean = lambda xs: sorted({x.strip() for x in xs or [] if x and x.strip()})
    keep: list[Column] = [F.col(c).isin(v) for c, v in (("domain", clean(domains)), ("document_id", clean(document_ids))) if v]
    if not keep:
        return None
    if metadata is None:
        raise ValueError("filters need metadata")
    return metadata.where(keep[0] if len(keep) == 1 else keep[0] & keep[1]).select("chunk").distinct()


def evaluate(questions: DataFrame, rankings: DataFrame, judgments: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per question and grouped metrics; positives outside the index stop it."""
    gone = M.missing_judgments(judgments, index).limit(5).collect()
    if gone:
        raise ValueError(f"judged chunks are not in the index: {[r.chunk for r in gone]}")
    per = M.question_metrics(questions, rankings, judgments)
    return per, M.grouped_metrics(per)


def evaluate_golden(golden: DataFrame, retriever: Bm25Retriever | DenseRetriever | HybridRetriever, split: str = "all", depth: int = 20, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """C10 from the question set on: F13, the split, J5, the search, and the metrics per question and grouped."""
    C.fail_closed(V.golden_violations(golden, strict))
    own = K.in_split(golden, split)
    index = retriever.spark.read.parquet(f"{retriever.path}/postings").select("chunk").distinct()
    judged = own.select(F.col("question_id").alias("question"), F.explode(K.judgment_map(F.col("relevance_judgments"))).alias("chunk", "grade"))
    # Searches number the questions, so their keys may be of any type.
    asked = own.select(F.xxhash64("question_id").alias("query_id"), "question_id", F.col("question").alias("text"))
    found = retriever.search(asked, depth).join(asked.select(F.col("query_id").alias("query"), F.col("question_id").alias("question")), "query").select("question", "chunk", "rank")
    return evaluate(own.select(F.col("question_id").alias("question"), "category", "difficulty", "split", "answerable"), found, judged, index)


def project_judgments(judgments: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Judgments (question, chunk, grade) of old spans (id, section, lo, hi) onto new ones; a positive that lands nowhere
    stops it. The best grade wins."""
    spans = C.project_intervals(old, new, "section").select(F.col("source_id").alias("chunk"), "target_id")
    positive = judgments.where("grade > 0")
    lost = positive.join(spans, "chunk", "left_anti").limit(5).collect()
    if lost:
        raise ValueError(f"judgments land nowhere: {[(r.question, r.chunk) for r in lost]}")
    return positive.join(spans, "chunk").groupBy("question", "target_id").agg(F.max("grade").alias("grade")).withColumnRenamed("target_id", "chunk")


def chunk_size_experiment(sections: DataFrame, measure: Callable[[DataFrame, str], DataFrame], variants: tuple[tuple[int, int], ...] = VARIANTS) -> DataFrame:
    """C14: ``measure`` (chunks, name) for each variant, as one table."""
    out = None
    for target, overlap in variants:
        name = f"{target}/{overlap}"
        part = measure(C.build_chunks(sections, settings=ChunkSettings(target, overlap)), name).withColumn("variant", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def answer_questions(questions: DataFrame, hits: DataFrame, backend: Any, system: str, retries: int = 1) -> DataFrame:
    """Evidence within the budget, the prompt, the model, the checks. Questions without evidence are not asked."""
    evidence = E.select_evidence(hits)
    grouped = evidence.groupBy("question").agg(F.sort_array(F.collect_list(F.struct("rank", "evidence_id", "excerpt"))).alias("e"))
    prompt = F.to_json(F.struct(F.col("text").alias("question"), F.transform("e", lambda x: F.struct(x["evidence_id"].alias("id"), x["excerpt"].alias("text"))).alias("evidence")))
    asked = questions.join(grouped, "question")
    raw = complete(asked.select(F.col("question").cast("string").alias("key"), F.lit(system).alias("system"), prompt.alias("user")), backend, retries)
    j = questions.join(grouped, "question", "left").join(raw, F.col("question").cast("string") == F.col("key"), "left")
    parsed = E.parse_generation(F.col("raw"), F.transform("e", lambda x: x["evidence_id"]))
    status = F.when(F.col("e").isNull(), "no_evidence").when(F.col("raw").isNull() | parsed["error"].isNotNull(), "generation_error").when(parsed["abstain"], "abstained").otherwise("answered")
    return j.select("question", status.alias("status"), F.when(status == "answered", parsed["answer"]).alias("answer"), F.when(status == "answered", parsed["citations"]).alias("citations"), F.coalesce("error", F.when(F.col("raw").isNotNull(), parsed["error"])).alias("error"))


def question_states(questions: DataFrame, hits: DataFrame, backend: Any, verifier: Any, retries: int = 1) -> DataFrame:
    """C19 from the questions on: answer, structural checks, verifier, one repair where the gate blocks, and the verifier again.

    Each model is asked once for the whole table of those rows that need it, and what it said is written before the next step.
    """
    evidence = E.select_evidence(hits).groupBy("question").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("evidence_id").alias("id"), F.col("excerpt").alias("text")))).alias("e"))
    first = answer_questions(questions, hits, backend, SYSTEM, retries)
    rows = questions.join(first, "question").join(evidence, "question", "left").withColumn("sources", F.transform("e", lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text"))))
    spoken = F.array_join(F.transform("sources", lambda x: x["text"]), "\n")
    flags = E.structural_checks(F.col("status"), F.col("answer"), F.col("citations"), spoken)["hard_flags"]
    rows = rows.withColumns({"hard": flags, "spoken": spoken})
    ask = lambda part, kind, model, system: complete(part.select(F.col("question").cast("string").alias("key"), F.lit(system).alias("system"), K.prompts(F.col("text"), F.col("answer"), F.col("sources"), F.col("hard"))[kind].alias("user")), model, retries).select(F.col("key").alias("__key"), F.col("raw").alias(f"{kind}_raw"))
    with_key = lambda left, right: left.join(right, F.col("question").cast("string") == F.col("__key"), "left").drop("__key")
    rows = with_key(rows, ask(rows.where((F.col("status") == "answered") & (F.size("hard") == 0)), "verify", verifier, VERIFIER))
    said = F.from_json("verify_raw", "verdict string, quotes array<string>")
    verdict = E.gate_verdict(F.col("status"), F.col("hard"), E.verified_verdict(said["verdict"], said["quotes"], F.col("spoken")), True, False)
    rows = rows.withColumn("verdict", verdict)
    blocked = F.col("verdict").isin("structural_failure", *E.BLOCKING)
    rows = with_key(rows, ask(rows.where(blocked), "repair", backend, SYSTEM))
    repaired = E.parse_generation(F.col("repair_raw"), F.transform("sources", lambda x: x["id"]))
    return rows.select("question", "status", "answer", "verdict", blocked.alias("blocked"), F.when(blocked, repaired["error"].isNull() & ~repaired["abstain"]).alias("repaired"), F.when(blocked, repaired["answer"]).alias("repaired_answer"))


def truncation_audit(lengths: DataFrame, column: str, limit: int = 512) -> DataFrame:
    """How many texts are longer than a model takes, and what would be lost."""
    n = F.col(column)
    return lengths.agg(F.count("*").alias("rows"), F.sum((n > limit).cast("long")).alias("truncated"), F.round(F.avg((n > limit).cast("double")), 6).alias("share"), F.sum(F.greatest(n - limit, F.lit(0))).alias("lost"), F.round(F.avg(n), 3).alias("mean"), F.median(n).alias("median"))


def is_deterministic(build: Callable[[], DataFrame]) -> bool:
    """Two builds give the same rows."""
    return C.row_differences(build(), build()).isEmpty()


def next_row_index(df: DataFrame, *order: str) -> DataFrame:
    """W28 for tables that are small: a dense row number over a total order. For large ones see ``w28_row_index``."""
    return df.withColumn("row_index", F.row_number().over(Window.orderBy(*order)) - 1)
