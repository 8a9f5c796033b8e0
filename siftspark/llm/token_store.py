"""Token ids on disk, bit-packed at the vocabulary's width.

A store is a folder with a Parquet table of blocks, written and committed by Spark on any file system it knows. The cell
``data`` of each row is one self-describing binary block of whole documents::

    "PIDB" | u8 version | u8 bits | u16 0 | u32 documents | u64 ids
    u8 has_key[documents] | pad to 8 | i64 key[documents] | u64 offset[documents + 1] | packed ids | pad to 8

Every id takes ``bits`` bits, the least that the vocabulary needs, little end first, so id k of a block begins at bit
k * bits: numpy unpacks a whole block or any slice of it without the ids before. A shard is what one task wrote; shards
follow each other in ascending doc_id order, ``shard_start`` counts the ids before a block in its shard, and the
totals of the shards (one small row a task) give the global start of each.

Documents are dealt by ranges of doc_id and sorted before they are encoded, so the text moves once and is encoded once.

Defined results: null or empty text is the end id alone; null doc_ids come first; rows that repeat a doc_id are ordered by
text (null first) and each keeps its own entry; an empty table gives an empty store; extra columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import new_scratch, ship_package
from .tokenizing import default_tokenizer_path, encoder

END_ID = 2
#: A block is closed at so many ids or documents, whichever comes first; a longer document has a block of its own.
BLOCK_IDS, BLOCK_DOCS = 1 << 16, 1 << 12
BLOCKS = "shard int, block int, shard_start long, n_ids long, n_docs int, data binary"
_MAGIC, _VERSION, _HEAD = b"PIDB", 1, struct.Struct("<4sBBHIQ")
_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("shard_start", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int32()), ("data", pa.binary())])
DOCS = "doc_id long, local_start long, n_tokens long, ids binary"
_DOC_ARROW = pa.schema([("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def bits_for(vocabulary: int) -> int:
    """The least bits that hold ids 0 .. vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if bits < 32 and ids.size and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit in {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    shown = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(shown.reshape(-1), bitorder="little").tobytes()


def unpack_bits(data: bytes | memoryview, bits: int, first: int, count: int) -> np.ndarray:
    """ids first .. first + count - 1 of packed data, touching the bytes that hold them alone."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count, first * bits // 8).astype("<u4")
    low, high = first * bits // 8, ((first + count) * bits + 7) // 8
    shown = np.unpackbits(np.frombuffer(data, np.uint8, high - low, low), bitorder="little")[first * bits - 8 * low :][: count * bits]
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = shown.reshape(count, bits)
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1)


def _pad(n: int) -> bytes:
    return bytes(-n % 8)


def build_block(keys: list[int | None], ids: list[bytes], bits: int) -> bytes:
    """keys and the ids (little-endian unsigned 32-bit) of whole documents."""
    counts = np.array([len(x) // 4 for x in ids], "<u8")
    offsets = np.concatenate([np.zeros(1, "<u8"), np.cumsum(counts, dtype="<u8")])
    has = bytes(k is not None for k in keys)
    packed = pack_bits(np.frombuffer(b"".join(ids), "<u4"), bits)
    return b"".join([_HEAD.pack(_MAGIC, _VERSION, bits, 0, len(keys), int(offsets[-1])), has, _pad(_HEAD.size + len(has)), np.array([k or 0 for k in keys], "<i8").tobytes(), offsets.tobytes(), packed, _pad(len(packed))])


class Block:
    """Random access to one binary block."""

    def __init__(self, data: bytes):
        magic, version, self.bits, _, self.n_docs, self.n_ids = _HEAD.unpack_from(data)
        if magic != _MAGIC or version != _VERSION:
            raise ValueError("not a block of packed ids")
        at = _HEAD.size
        has = data[at : at + self.n_docs]
        at += self.n_docs + len(_pad(at + self.n_docs))
        raw = np.frombuffer(data, "<i8", self.n_docs, at)
        self.keys = [int(k) if h else None for k, h in zip(raw, has, strict=True)]
        at += 8 * self.n_docs
        self.offsets = np.frombuffer(data, "<u8", self.n_docs + 1, at).astype(np.int64)
        self._packed = memoryview(data)[at + 8 * (self.n_docs + 1) :]

    def ids(self, first: int = 0, count: int | None = None) -> np.ndarray:
        return unpack_bits(self._packed, self.bits, first, self.n_ids - first if count is None else count)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.offsets[k]), int(self.offsets[k + 1] - self.offsets[k]))


def _writer(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        bits, end, shard = bits_for(max(enc.vocabulary, end_id + 1)), end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        keys: list[int | None] = []
        ids: list[bytes] = []
        held = block = start = 0

        def close() -> pa.RecordBatch:
            row = (shard, block, start, held, len(keys), build_block(keys, ids, bits))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _ARROW, strict=True)], schema=_ARROW)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = enc.encode(text.as_py()) + end
                if keys and (held + len(own) // 4 > BLOCK_IDS or len(keys) >= BLOCK_DOCS):
                    yield close()
                    keys, ids, block, start, held = [], [], block + 1, start + held, 0
                keys.append(key)
                ids.append(own)
                held += len(own) // 4
        if keys:
            yield close()

    return run


def write_store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = END_ID) -> None:
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    ordered.mapInArrow(_writer(tokenizer_path or default_tokenizer_path(), end_id), BLOCKS).write.parquet(path)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for base, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            b = Block(data.as_py())
            ids, at = b.ids(), b.offsets
            rows = [(k, base + int(at[i]), int(at[i + 1] - at[i]), ids[at[i] : at[i + 1]].tobytes()) for i, k in enumerate(b.keys)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _DOC_ARROW, strict=True)], schema=_DOC_ARROW)


def shard_bases(blocks: DataFrame) -> DataFrame:
    """(shard, base): ids in all shards before; a row for each task that wrote, from narrow columns alone."""
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    return totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids."""
    ship_package(spark)
    blocks = spark.read.schema(BLOCKS).parquet(path)
    # A row a write task, whose number the driver's own bookkeeping bounds.
    placed = blocks.join(F.broadcast(shard_bases(blocks)), "shard").select((F.col("base") + F.col("shard_start")).alias("base"), "data")
    return placed.mapInArrow(_reader, DOCS).withColumnRenamed("local_start", "start")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write a store in the shared folder and read it back."""
    path = new_scratch(docs.sparkSession, "token-store")
    write_store(docs, path, **options)
    return read_store(docs.sparkSession, path)


def store_report(stored: DataFrame) -> DataFrame:
    return stored.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
