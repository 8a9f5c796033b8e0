"""A training corpus from raw documents in five stages.

quality rules -> line dedup -> near dedup -> benchmark decontamination -> packing. Each stage is one of the operators in
``siftspark.llm`` and works on all that the stage before it kept; its result is written as Parquet in the shared folder and
read again. All but the last return the columns of documents; after line dedup, ``n_chars`` counts the text that is left.

Odd rows: an empty table passes every stage as an empty table. Null, empty and blank texts fail the quality rules (fewer than
ten words), so later stages meet them only if they are called alone; each stage says below what it does then. Very long texts
are read whole in every stage. Extra columns are kept, whatever their names, until packing, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.llm import decontaminate, line_dedup, near_dedup, packing, quality_cascade
from siftspark.llm._shared import durable, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Rows are judged one by one, so repeated rows share a verdict; null text is rejected."""
    return quality_cascade.quality_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that repeat over documents, but where they stay.

    No row goes: null text stays null, and a text may become empty. Rows that repeat a doc_id count as one document; rows with a
    null doc_id are together one document, below all others. A repeated line stays in the largest doc_id, so there are no ties.
    """
    out = line_dedup.line_dedup_texts(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least doc_id (a null doc_id is below no other).

    Of equal rows one stays. Null, empty and blank texts have no group and stay.
    """
    return near_dedup.near_dedup(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. Null and empty texts hold none and stay; equal rows go or stay together; null items match nothing."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece of a document, with its ids. Null and empty texts are the end id alone; a null doc_id stays null."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("packing", pack),
]

#: SQL has no tokenizer and no edit matching; tests/llm holds the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
