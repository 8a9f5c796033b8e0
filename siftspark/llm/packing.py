"""Packing by power-of-two decomposition.

A document of n ids is cut along the binary digits of n: first whole sequences of ``max_len`` ids, then one piece for each
set bit of the rest, largest first. Every piece is a sequence of its own, so no sequence crosses documents and nothing is
padded; pieces of equal length share a bucket (``bucket`` = log2 of the length), and a training batch takes sequences of
one bucket. Each task numbers its sequences in its own range, so nothing is shuffled, sorted or counted first.

Defined results: null or empty text is the end id alone, one piece of one id; repeated rows are packed one by one; a null
doc_id stays null; an empty table gives no rows; extra columns are ignored. A task that is run again numbers the same
rows of its partition anew, and only one of its results is kept, so sequence_id stays unique.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ship_package
from .tokenizing import default_tokenizer_path, encoder

MAX_LEN, END_ID = 1024, 0
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, bucket int"
#: A batch of rows to Spark is closed at this many bytes of ids.
_FLUSH = 4 << 20
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("bucket", pa.int32())])


def piece_lengths(n: int, max_len: int = MAX_LEN) -> list[int]:
    """Binary pieces of n: max_len as often as it fits, then the set bits of the rest from the top."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << b for b in reversed(range(max_len.bit_length())) if rest >> b & 1]


def _packer(path: str, max_len: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path).encode, end_id.to_bytes(4, "little")
        serial = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                n, start = len(ids) // 4, 0
                for length in piece_lengths(n, max_len):
                    rows.append((doc, start, length, ids[4 * start : 4 * (start + length)], n, serial, 0, length.bit_length() - 1))
                    start, serial = start + length, serial + 1
                held += len(ids)
                if held >= _FLUSH:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, max_len: int = MAX_LEN, end_id: int = END_ID) -> DataFrame:
    """One row per piece with its ids (little-endian unsigned 32-bit); max_len must be a power of two."""
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_packer(tokenizer_path or default_tokenizer_path(), max_len, end_id), SCHEMA)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Sequences in a folder for each length, ready to be batched."""
    pieces.write.partitionBy("bucket").parquet(path)


def piece_report(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
