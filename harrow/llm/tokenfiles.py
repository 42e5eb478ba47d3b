"""Token-id files: documents in ascending id order, in independently coded blocks.

A file set is a folder of Parquet files whose rows are blocks: ``part`` and
``block`` (their order is the order of the documents), ``n_ids``, ``docs`` (the
block's documents: ids and lengths, deflated) and ``payload`` (see
``harrow.llm.codec``). Spark's own writer commits them, so that a lost executor
leaves no half-written file, and any store that Spark reaches will do.

Edge cases. A null or empty text has the end id alone; ids are whole numbers,
others are an error; a null id comes first;
repeated ids stay rows of their own, ordered by a hash of their text; a text of
any length stays in one block; an empty table gives an empty file set; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrow.llm.codec import decode_block, encode_block
from harrow.llm.common import attach, scratch, table
from harrow.llm.tokens import WordEncoder

END_ID = 1
VOCABULARY = 49_408
#: A block ends with the document that reaches this number of ids.
BLOCK_IDS = 2_000_000
_TEXTS = 4096
FILE_SCHEMA = "part long, block long, n_ids long, docs binary, payload binary"
DOC_SCHEMA = "_block long, doc_id long, _before long, n_tokens long, ids_crc32 long"

_encoders: dict[str | None, WordEncoder] = {}


def _encoder(path: str | None) -> WordEncoder:
    """One per Python worker and file, so that its cache serves all tasks there."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _pack_docs(doc_ids: list[int | None], lengths: list[int]) -> bytes:
    null = np.fromiter((d is None for d in doc_ids), np.uint8, len(doc_ids))
    ids = np.fromiter((d or 0 for d in doc_ids), "<i8", len(doc_ids))
    return zlib.compress(null.tobytes() + ids.tobytes() + np.array(lengths, "<u4").tobytes(), 1)


def _unpack_docs(data: bytes) -> tuple[list[int | None], np.ndarray]:
    raw = zlib.decompress(data)
    n = len(raw) // 13
    null = np.frombuffer(raw, np.uint8, n)
    ids = np.frombuffer(raw, "<i8", n, n).tolist()
    return [None if z else d for z, d in zip(null, ids, strict=True)], np.frombuffer(raw, "<u4", n, 9 * n).astype(np.int64)


def _write(batches: Iterator[pa.RecordBatch], path: str | None, vocabulary: int, block_ids: int) -> Iterator[pa.RecordBatch]:
    encoder, part, block = _encoder(path), TaskContext.get().partitionId(), 0
    doc_ids: list[int | None] = []
    lengths: list[int] = []
    chunks: list[np.ndarray] = []
    waiting = 0

    def flushed() -> pa.RecordBatch:
        nonlocal block, waiting
        row = (part, block, waiting, _pack_docs(doc_ids, lengths), encode_block(np.concatenate(chunks), vocabulary))
        block, waiting = block + 1, 0
        for x in (doc_ids, lengths, chunks):
            x.clear()
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["part", "block", "n_ids", "docs", "payload"])

    for batch in batches:
        for at in range(0, batch.num_rows, _TEXTS):
            some = batch.slice(at, _TEXTS)
            ids, sizes = encoder.encode(some.column(1))
            ends = np.cumsum(sizes)
            ids = np.insert(ids.astype(np.int32), ends, END_ID)
            sizes = sizes + 1
            start = 0
            for doc_id, end, size in zip(some.column(0).to_pylist(), np.cumsum(sizes).tolist(), sizes.tolist(), strict=True):
                doc_ids.append(doc_id)
                lengths.append(size)
                waiting += size
                if waiting >= block_ids:
                    chunks.append(ids[start:end])
                    start = end
                    yield flushed()
            if start < len(ids):
                chunks.append(ids[start:])
    if doc_ids:
        yield flushed()


def write_token_files(docs: DataFrame, path: str, vocabulary_path: str | None = None, vocabulary: int = VOCABULARY, block_ids: int = BLOCK_IDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` as a file set at ``path``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered.mapInArrow(lambda batches: _write(batches, vocabulary_path, vocabulary, block_ids), FILE_SCHEMA).write.parquet(path)


def read_token_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a file set."""
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, block, docs, payload in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            doc_ids, lengths = _unpack_docs(docs)
            ids = decode_block(payload).astype("<u4")
            ends = np.cumsum(lengths)
            raw, crcs = memoryview(ids).cast("B"), []
            for end, n in zip(ends.tolist(), lengths.tolist(), strict=True):
                crcs.append(zlib.crc32(raw[4 * (end - n) : 4 * end]))
            n = len(doc_ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part << 32 | block)), pa.array(doc_ids, pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64())], ["_block", "doc_id", "_before", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a file set: doc_id, start, n_tokens, ids_crc32, as decoded from the files."""
    blocks = read_token_blocks(spark, path)
    sizes = blocks.select("part", "block", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    parts = parts.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_parts_before"))
    earlier = F.sum("n_ids").over(Window.partitionBy("part").orderBy("block")) - F.col("n_ids")
    starts = sizes.select("part", "block", earlier.alias("_blocks_before")).join(parts, "part")
    starts = starts.select((F.shiftleft("part", 32) + F.col("block")).alias("_block"), (F.col("_parts_before") + F.col("_blocks_before")).alias("_from"))
    docs = blocks.select("part", "block", "docs", "payload").mapInArrow(_read, DOC_SCHEMA)
    return attach(docs, starts, "_block").select("doc_id", (F.col("_from") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` written to a file set and read back."""
    path = scratch(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path)
