"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

Documents are cut into pieces, a block's pieces are spread over its windows by
the largest differencing method (two partial partitions at a time, the fullest
windows of one onto the emptiest of the other), and the window count rises until
none exceeds the capacity. A block has a fixed number of tokens, so that memory is
bounded and a partition is packed in one pass, without a shuffle.

Edge cases. A null or empty text still has its end id and is one piece of length
1; ids are whole numbers, others are an error; a null id stays null; repeated rows are documents of their own; texts of any
length are cut; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from harrow.llm.common import table
from harrow.llm.tokens import byte_bpe_encoder

CAPACITY = 2048
#: Documents are cut finer than a window, so that the windows of a block come out near-equal.
PIECE = CAPACITY // 4
#: Windows in a block.
BLOCK_WINDOWS = 192
END_ID = 1

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]


def multiway_difference(lengths: list[int], k: int) -> list[list[int]]:
    """Item numbers of each of ``k`` windows, by the largest differencing method.

    A partial partition is its non-empty windows in descending order of sum, each
    with the tree of its items. The two with the largest differences are merged
    with opposed order until one is left.
    """
    heap: list[tuple[int, int, list]] = [(-n, i, [(n, i)]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    tick = len(lengths)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        clash = max(0, k - len(b))  # from here on a's windows meet b's
        merged = a[:clash] + [(a[i][0] + b[k - 1 - i][0], (a[i][1], b[k - 1 - i][1])) for i in range(clash, len(a))] + b[: k - len(a)]
        merged.sort(key=lambda w: -w[0])
        least = merged[-1][0] if len(merged) == k else 0
        heapq.heappush(heap, (least - merged[0][0], tick, merged))
        tick += 1
    out: list[list[int]] = []
    for _, tree in heap[0][2] if heap else []:
        items, stack = [], [tree]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += node
            else:
                items.append(node)
        out.append(sorted(items))
    return out


def pack_block(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows (lists of item numbers) none of which exceeds ``capacity``."""
    k = max(1, -(-sum(lengths) // capacity))
    while True:
        windows = multiway_difference(lengths, k)
        most = max((sum(lengths[i] for i in w) for w in windows), default=0)
        if most <= capacity:
            return windows
        k += max(1, k * (most - capacity) // capacity)


def pack_partition(batches: Iterator[pa.RecordBatch], capacity: int = CAPACITY, piece: int = PIECE, block_windows: int = BLOCK_WINDOWS) -> Iterator[pa.RecordBatch]:
    """Documents (doc_id, text) of one partition -> the pieces of their sequences."""
    encode = byte_bpe_encoder()
    first = TaskContext.get().partitionId() << 32 if TaskContext.get() else 0
    block = block_windows * capacity
    waiting: list[tuple[int | None, np.ndarray]] = []
    tokens = sequence = 0

    def packed(docs: list[tuple[int | None, np.ndarray]]) -> pa.RecordBatch:
        nonlocal sequence
        pieces = [(d, s, min(piece, len(ids) - s)) for d, (_, ids) in enumerate(docs) for s in range(0, len(ids), piece)]
        rows: list[list] = [[] for _ in _COLUMNS]
        for window in pack_block([n for _, _, n in pieces], capacity):
            at = i = 0
            while i < len(window):
                d, s, n = pieces[window[i]]
                i += 1
                while i < len(window) and pieces[window[i]][0] == d and pieces[window[i]][1] == s + n:  # neighbours make one piece
                    n += pieces[window[i]][2]
                    i += 1
                doc_id, ids = docs[d]
                for column, value in zip(rows, (doc_id, s, n, zlib.crc32(ids[s : s + n].tobytes()), len(ids), first + sequence, at), strict=True):
                    column.append(value)
                at += n
            sequence += 1
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], _COLUMNS)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = np.array([*encode(text or ""), END_ID], "<u4")
            waiting.append((doc_id, ids))
            tokens += len(ids)
            if tokens >= 2 * block:  # the rest is a block at least, so that no small one remains
                size = cut = 0
                while size < block:
                    size += len(waiting[cut][1])
                    cut += 1
                yield packed(waiting[:cut])
                del waiting[:cut]
                tokens -= size
    if waiting:
        yield packed(waiting)


def pack(docs: DataFrame, capacity: int = CAPACITY, piece: int = PIECE, block_windows: int = BLOCK_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of ``docs`` in sequences of at most ``capacity`` ids, one row each."""
    from pyspark.sql import functions as F

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda batches: pack_partition(batches, capacity, piece, block_windows), SCHEMA)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed, one row per piece."""
    return pack(table(spark, sf_dir, "documents"))
