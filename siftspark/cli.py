"""Command lines: ``python -m siftspark <command>``. Every command prints a table or JSON lines and ends with 0, or with 1 and the
reason on stderr; a generation run in which some questions failed ends with 2."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.chunking import ChunkSettings
from .functions.html_blocks import blocks_of
from .operators import checks as K
from .operators import corpus as C
from .operators import metrics as M
from .operators import retrieval as R
from .operators import validation as V
from .plans import pipelines as P
from .sources import chat, files

DOCUMENT = "document_id string, domain string, title string, url string"
CHUNK = "chunk_id string, section_id string, document_id string, domain string, heading_path array<string>, text string, token_count int"
QUESTION = "question_id string, question string, category string, difficulty string, split string, answerable boolean, relevance_judgments array<struct<chunk_id:string,grade:int>>"

#: Every command's function, and its arguments as (flag, settings).
COMMANDS: dict[str, tuple[Callable[[SparkSession, argparse.Namespace], DataFrame | dict], list[tuple[str, dict[str, Any]]]]] = {}


def command(name: str, *arguments: tuple[str, dict[str, Any]]):
    def put(f):
        COMMANDS[name] = (f, list(arguments))
        return f

    return put


_need = {"required": True}
_IN, _OUT, _INDEX = ("--input", _need), ("--output", _need), ("--index", _need)
_FILTERS = [("--domain", {"action": "append", "default": []}), ("--document-id", {"action": "append", "default": []})]
_OVERWRITE = ("--overwrite", {"action": "store_true"})


@command("validate-manifest", _IN, ("--host", {"action": "append", "required": True}))
def validate_manifest(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    faults = V.manifest_violations(files.read_manifest(spark, a.input), tuple(a.host))
    return _closed(faults)


@command("validate-golden", _IN)
def validate_golden(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return _closed(V.golden_violations(files.read_jsonl(spark, a.input, QUESTION)))


@command("extract", _IN, _OUT, _OVERWRITE)
def extract(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    pages = files.read_html(spark, a.input)
    blocks = pages.select("document_id", F.explode(blocks_of(F.col("html"), F.lit(None).cast("string"))).alias("b")).select("document_id", "b.*")
    files.write_jsonl(blocks, a.output, ["document_id", "block_index"], overwrite=a.overwrite)
    return C.count_by(blocks, "type")


@command("build-chunks", _IN, _OUT, _OVERWRITE, ("--tokenizer", {}), ("--target", {"type": int, "default": 512}), ("--overlap", {"type": int, "default": 64}), ("--section-id", {"action": "append", "default": []}), ("--limit", {"type": int}), *_FILTERS[1:])
def build_chunks(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    sections = K.select_rows(files.read_jsonl(spark, a.input, "section_id string, document_id string, text string"), ["section_id"], a.limit, document_id=a.document_id, section_id=a.section_id)
    chunks = C.build_chunks(sections, settings=ChunkSettings(a.target, a.overlap), tokenizer_path=a.tokenizer)
    C.fail_closed(C.chunk_violations(chunks, "section_id", ChunkSettings(a.target, a.overlap)))
    files.write_jsonl(chunks, a.output, ["section_id", "chunk_index"], overwrite=a.overwrite)
    return K.stage_report(chunks, F.lit("written"), tokens=F.col("token_count"))


@command("prepare", _IN, _OUT, _OVERWRITE)
def prepare(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    chunks = files.read_jsonl(spark, a.input, CHUNK)
    files.write_jsonl(P.prepare_corpus(chunks), a.output, ["chunk_id"], overwrite=a.overwrite)
    return C.count_by(C.prepare_chunks(chunks), "domain", "indexable")


@command("build-index", _IN, _OUT, ("--dense", {"action": "store_true"}))
def build_index(spark: SparkSession, a: argparse.Namespace) -> dict:
    chunks = files.read_jsonl(spark, a.input, CHUNK + ", retrieval_text string")
    P.build_bm25_index(chunks, a.output)
    if a.dense:
        P.build_dense_index(chunks, a.output)
    chunks.select(F.col("chunk_id").alias("chunk"), "domain", "document_id").write.mode("overwrite").parquet(f"{a.output}/metadata")
    chunks.select(F.col("chunk_id").alias("chunk"), "text").write.mode("overwrite").parquet(f"{a.output}/texts")
    return P.Bm25Retriever(spark, a.output).describe()


@command("describe", _INDEX)
def describe(spark: SparkSession, a: argparse.Namespace) -> dict:
    return {"bm25": P.Bm25Retriever(spark, a.index).describe(), "hybrid": P.HybridRetriever(spark, a.index).describe()}


@command("search", _INDEX, ("--query", {"action": "append", "required": True}), ("--top-k", {"type": int, "default": 10}), ("--system", {"choices": ["bm25", "dense", "hybrid"], "default": "hybrid"}), *_FILTERS)
def search(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    asked = spark.createDataFrame(list(enumerate(a.query)), "query_id long, text string")
    made = {"bm25": P.Bm25Retriever, "dense": P.DenseRetriever, "hybrid": P.HybridRetriever}[a.system](spark, a.index)
    return made.search(asked, a.top_k, spark.read.parquet(f"{a.index}/metadata"), a.domain, a.document_id).orderBy("query", "rank")


@command("evaluate", _INDEX, _IN, ("--split", {"choices": ["dev", "test", "all"], "default": "all"}), ("--system", {"choices": ["bm25", "dense", "hybrid"], "default": "hybrid"}), ("--loose", {"action": "store_true"}))
def evaluate(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    golden = files.read_jsonl(spark, a.input, QUESTION)
    made = {"bm25": P.Bm25Retriever, "dense": P.DenseRetriever, "hybrid": P.HybridRetriever}[a.system](spark, a.index)
    return P.evaluate_golden(golden, made, a.split, strict=not a.loose)[1].orderBy("grouping", "value")


@command("gate", ("--measured", _need), ("--frozen", _need))
def gate(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    lost = M.gate(files.read_jsonl(spark, a.measured, "metric string, value double"), files.read_jsonl(spark, a.frozen, "metric string, frozen double, tolerance double"))
    return _closed(lost.select(F.lit("regression").alias("rule"), F.col("metric").alias("key"), F.coalesce(F.col("value").cast("string"), F.lit("missing")).alias("detail")))


@command("ask", _INDEX, ("--question", {"action": "append", "required": True}), ("--provider", {"choices": sorted(chat.PROVIDERS), "default": "ollama"}), ("--server", _need), ("--model", _need), ("--top-k", {"type": int, "default": 8}), ("--retries", {"type": int, "default": 1}), *_FILTERS)
def ask(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if not 1 <= a.top_k <= 20:
        raise ValueError("--top-k is 1 to 20")
    asked = spark.createDataFrame(list(enumerate(a.question)), "query_id long, text string")
    found = P.HybridRetriever(spark, a.index).search(asked, a.top_k, spark.read.parquet(f"{a.index}/metadata"), a.domain, a.document_id)
    texts = spark.read.parquet(f"{a.index}/texts").select("chunk", "text")
    hits = found.join(texts, "chunk").select(F.col("query").alias("question"), "chunk", "rank", "text")
    return P.answer_questions(asked.withColumnRenamed("query_id", "question"), hits, chat.HttpChat(a.provider, a.server, a.model), P.SYSTEM, a.retries).orderBy("question")


def _closed(violations: DataFrame) -> DataFrame:
    """The checks' rows if there are none; else an error that names the first."""
    C.fail_closed(violations)
    return violations


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("siftspark")
    commands = p.add_subparsers(dest="command", required=True)
    for name, (f, arguments) in COMMANDS.items():
        own = commands.add_parser(name, help=(f.__doc__ or name).splitlines()[0])
        for flag, settings in arguments:
            own.add_argument(flag, **settings)
        own.add_argument("--json", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("siftspark").getOrCreate()
    try:
        out = COMMANDS[a.command][0](spark, a)
        if isinstance(out, dict):
            print(files.canonical_json(out))
            return 0
        print(files.render(out, a.json))
        return 2 if a.command == "ask" and not out.where("status = 'generation_error'").isEmpty() else 0
    except Exception as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
