"""Readers and writers of corpus files. Readers fail on the first bad record; writers are deterministic.

Spark reads and writes all tables, on any file system it knows. Small reports and manifests are driver files.
"""

from __future__ import annotations

import hashlib
import json
import os
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import csv_safe

BOM = "﻿"


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str | T.StructType, required: tuple[str, ...] = (), allow_empty: bool = False) -> DataFrame:
    """One object a line, blank lines skipped, anything else an error when read. No schema is inferred."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if not allow_empty and df.isEmpty():
        raise ValueError(f"no records in {path}")
    for c in required:
        df = df.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"missing field {c}")).cast(df.schema[c].dataType)).otherwise(F.col(c)))
    return df


def read_json_documents(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """S3: one object a file, over as many lines as it likes."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)


def read_manifest(spark: SparkSession, path: str, key: str = "documents", schema: str = "id string, domain string, title string, url string, rationale string") -> DataFrame:
    """The list under ``key`` of a YAML mapping."""
    import yaml

    loaded = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(loaded, dict) or not isinstance(loaded.get(key), list):
        raise ValueError(f"{path} is not a mapping with a list {key}")
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    return spark.createDataFrame([tuple(d.get(n) for n in names) for d in loaded[key]], schema)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A small NPY matrix as (row_index, vector); large ones belong in Parquet from the start."""
    import numpy as np

    m = np.load(path, allow_pickle=False)
    if m.ndim != 2:
        raise ValueError(f"{path} is not a matrix")
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "row_index long, vector array<float>")


def write_matrix(rows: DataFrame, path: str, index: str = "row_index", vector: str = "vector", most_bytes: int = 1 << 30, overwrite: bool = False) -> None:
    """K4: (row_index, vector) as one NPY matrix of float32, row by row in order. It is one file on the driver's disk, so it is for
    exports of a stated size (``most_bytes``); Parquet is the form for the rest. Rows are streamed, not collected."""
    import numpy as np

    facts = rows.agg(F.count("*").alias("n"), F.min(F.size(vector)).alias("low"), F.max(F.size(vector)).alias("high"), F.min(index).alias("first"), F.max(index).alias("last"), F.count_distinct(index).alias("d")).first()
    if facts.n and (facts.low != facts.high or facts.first != 0 or facts.last != facts.n - 1 or facts.d != facts.n):
        raise ValueError(f"not a matrix with rows 0 to n - 1: {facts.asDict()}")
    width = facts.high or 0
    if 4 * facts.n * width > most_bytes:
        raise ValueError("the matrix is larger than the stated size; write Parquet")
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    tmp = f"{path}.tmp-{os.getpid()}"
    with open(tmp, "wb") as f:
        np.lib.format.write_array_header_1_0(f, {"descr": "<f4", "fortran_order": False, "shape": (facts.n, width)})
        for r in rows.select(index, vector).orderBy(index).toLocalIterator():
            f.write(np.asarray(r[1], "<f4").tobytes())
    os.replace(tmp, path)


def content_hash(df: DataFrame, order: list[str]) -> str:
    """K2: sha256 of the file that ``write_jsonl`` makes of the rows with ``single_file``; lines come to the driver one by one."""
    h = hashlib.sha256()
    for r in df.orderBy(*order).select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).toLocalIterator():
        h.update(r.value.encode("utf-8") + b"\n")
    return h.hexdigest()


def render(df: DataFrame, as_json: bool = False, rows: int = 50, width: int = 60) -> str:
    """The first rows as a table for people, or as JSON lines."""
    head = df.limit(rows).collect()
    if as_json:
        return "\n".join(canonical_json(r.asDict(recursive=True)) for r in head)
    flat = [["" if v is None else " ".join(str(v).split()) for v in r] for r in head]
    lines = [df.columns, *[[c if len(c) <= width else c[: width - 1] + "…" for c in r] for r in flat]]
    size = [max(len(x[i]) for x in lines) for i in range(len(df.columns))]
    return "\n".join("  ".join(c.ljust(n) for c, n in zip(x, size, strict=True)).rstrip() for x in lines)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Quoted CSV with a header that must be exactly ``columns``; a byte order mark is not part of the first name."""
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    names = [c.removeprefix(BOM) for c in df.columns]
    if names != columns:
        raise ValueError(f"columns are {names}, not {columns}")
    return df.toDF(*names)


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, html, sha256) of the .html files of a folder; an empty file is an error when read."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(path)
    html = F.when(F.length("content") == 0, F.raise_error(F.concat(F.lit("empty file "), F.col("path"))).cast("string")).otherwise(F.decode("content", "utf-8"))
    return raw.select(F.regexp_extract("path", r"([^/]+)\.html$", 1).alias("document_id"), html.alias("html"), file_hash(F.col("content")).alias("sha256"))


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """sha256 of each file below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", file_hash(F.col("content")).alias("sha256"))


def canonical_lines(df: DataFrame) -> DataFrame:
    """K2: a JSON line a row, keys in order, nulls kept."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(df: DataFrame, path: str, order: list[str], single_file: bool = False, overwrite: bool = False, gzip: bool = False) -> None:
    """K1-K3, K9: rows in order over the part files; one file only where the caller says the table is small. Refuses to
    overwrite unless told to."""
    ordered = (df.coalesce(1).sortWithinPartitions(*order)) if single_file else df.orderBy(*order)
    w = canonical_lines(ordered).write.mode("overwrite" if overwrite else "errorifexists")
    (w.option("compression", "gzip") if gzip else w).text(path)


def write_review_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """K6: text cells can't be taken for formulas; the file starts with a byte order mark. Reviews are made by hand, so small."""
    rows = df.select(*[csv_safe(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]).toPandas()
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    write_atomic(path, (BOM + rows.to_csv(index=False, lineterminator="\n")).encode("utf-8"))


def fence(text: Column) -> Column:
    """K7: backticks, one more than the longest run in the text, three at least."""
    runs = F.regexp_extract_all(text, F.lit("`+"), F.lit(0))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)) + 1).cast("int"))


def packet_markdown(df: DataFrame, group: str, order: str, title: str, body: str) -> DataFrame:
    """K7: one Markdown text a group, its entries fenced in order."""
    entry = F.concat(F.lit("### "), F.col(title), F.lit("\n\n"), fence(F.col(body)), F.lit("\n"), F.col(body), F.lit("\n"), fence(F.col(body)), F.lit("\n"))
    g = df.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), entry.alias("e")))).alias("x"))
    return g.select(group, F.concat(F.lit("## "), F.col(group).cast("string"), F.lit("\n\n"), F.array_join(F.transform("x", lambda e: e["e"]), "\n")).alias("markdown"))


def write_atomic(path: str, data: bytes) -> None:
    """K1: a driver file that is there whole or not at all."""
    tmp = f"{path}.tmp-{os.getpid()}"
    Path(tmp).write_bytes(data)
    os.replace(tmp, path)


def canonical_json(value: Any) -> str:
    """P18 on the driver."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def settings_hash(settings: dict[str, Any]) -> str:
    """What makes two runs comparable."""
    return hashlib.sha256(canonical_json(settings).encode("utf-8")).hexdigest()


def write_report(path: str, report: dict[str, Any]) -> None:
    """K8: a small report or manifest on the driver."""
    write_atomic(path, (json.dumps(report, sort_keys=True, indent=2, ensure_ascii=False) + "\n").encode("utf-8"))


def check_written(df: DataFrame, index: str = "row_index") -> None:
    """Row numbers of a table that was just written run from 0 without gap or repeat."""
    r = df.agg(F.count("*").alias("n"), F.min(index).alias("low"), F.max(index).alias("high"), F.count_distinct(index).alias("d")).first()
    if r.n and (r.low != 0 or r.high != r.n - 1 or r.d != r.n):
        raise ValueError(f"{index} is not contiguous: {r.asDict()}")
