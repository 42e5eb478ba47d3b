"""Suffix-array dedup of repeated substrings by difference-cover blockwise construction.

A byte is removed if it lies in a string of ``length`` bytes that starts anywhere
else as well. Whether a suffix repeats for ``length`` bytes shows at its neighbours
in suffix order, and only this part of the order is built:

1. *Cover sample.* In each text every position whose offset modulo v lies in a
   difference cover is sampled. For any two positions there is a shift below v
   that takes both into the sample. So if two suffixes agree on ``length`` bytes,
   two sampled ones agree on their ``length - v + 1`` bytes. The sample is ranked
   by 64 bits of these bytes; equal ones share a rank, and only shared ranks matter.
2. *Suffix buckets.* A suffix without a sampled position of shared rank among its
   next v cannot repeat and drops out. The others go to buckets by 128 bits of
   their first ``length`` bytes; equal keys are what remains of a long tie. The key
   ranges are built one after the other, and each is sorted one bucket at a time,
   so that memory and disk hold one range.
3. *Removal.* Suffixes with an equal neighbour mark their bytes.

Text is only dealt out in blocks of whole documents; what the blocks exchange are
sorted keys, one per block however often it occurs there, and one bit each in
answer. A passage that all documents share is thus one entry per block. With n
suffixes left, a false match has a chance of about n^2 / 2^129 over the whole
corpus; collisions of the sample's 64 bits only let a suffix through to step 2.

Longer texts than a block are cut into pieces of a block that overlap by
``length - 1`` bytes, so that each suffix starts in one piece; a piece's own cover
sample reaches into the overlap, which can only let more suffixes through to step
2. The pieces' marked bytes meet again at their text. A block takes about 25 times
its bytes of a worker's memory, a long text in that last step about 3 times. Rows
are dealt to blocks by a hash of id and text; if rows that repeat both fill a block
beyond measure, all are dealt row by row instead, by a staged table.

Edge cases. A null text counts as empty; texts shorter than ``length`` lose
nothing; repeated rows are documents of their own, and so all their bytes repeat
if they are long enough; a null id is an id; texts of any length are read whole; an
empty table gives an empty result; other columns are carried along by ``dedup``.
Where a removed span cuts a character, its remaining bytes are left out of the
text, but not out of the digest columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.llm.common import staged, table

LENGTH = 200
#: A perfect difference cover: every number modulo V is a difference of two members.
COVER = (0, 1, 3, 9, 27, 49, 56, 61, 77, 81)
V = 91
#: Bytes of text in a block.
BLOCK_BYTES = 4 << 20
#: Blocks for each bucket of the sample and of the suffixes, so that a bucket holds as many keys as that at most.
SAMPLE_BLOCKS, SUFFIX_BLOCKS = 8, 2
#: Blocks' worth of text in one block from which on rows are dealt row by row.
FULL_BLOCKS = 4
#: Key ranges that are built one after the other.
RANGES = 3

_CHUNK = 1 << 17
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_U = np.uint64
ANSWER = "blk int, bucket int, bits binary"
_CELL = "bucket int, blk int, n int, payload binary"


@lru_cache(maxsize=8)
def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2^64, and a random word for each byte."""
    out = []
    for b in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
        p, have, top = np.ones(n, _U), 1, b
        while have < n:
            m = min(have, n - have)
            p[have : have + m] = p[:m] * _U(top)
            have, top = have + m, top * top % (1 << 64)
        out.append(p)
    words = np.random.default_rng(20_021 + which).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
    return out[0], out[1], words


def fingerprints(text: np.ndarray, at: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """64-bit fingerprints of the ``length`` bytes from each of the ascending positions; ``which`` of two independent ones."""
    power, inverse, word = _powers(_CHUNK + length, which)
    out = np.empty(len(at), _U)
    cuts = np.searchsorted(at, np.arange(0, len(text) + _CHUNK, _CHUNK))
    for c in range(len(cuts) - 1):
        a, b = cuts[c], cuts[c + 1]
        if a == b:
            continue
        s = c * _CHUNK
        part = word[text[s : s + _CHUNK + length]]
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum(part * power[: len(part)], out=sums[1:])
        i = at[a:b] - s
        out[a:b] = (sums[i + length] - sums[i]) * inverse[i]
    out ^= out >> _U(32)
    out *= _U(0xD6E8FEB86659FD93)
    out ^= out >> _U(29)
    return out


class _Block:
    """The documents of a block, in a fixed order, as one byte array."""

    def __init__(self, docs: pa.Table):
        texts = [x or b"" for x in docs.column("_text").to_pylist()]
        ids = docs.column("_id").to_pylist()
        self.order = sorted(range(len(texts)), key=lambda i: (ids[i] is not None, ids[i] if ids[i] is not None else "", texts[i]))
        self.texts = [texts[i] for i in self.order]
        self.sizes = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        self.ends = np.cumsum(self.sizes)
        self.text = np.frombuffer(b"".join(self.texts), np.uint8)

    def sample(self, length: int) -> np.ndarray:
        """Sampled positions with enough bytes after them in their document."""
        need = length - V + 1
        cover = np.array(COVER)
        found = []
        for start, size in zip((self.ends - self.sizes).tolist(), self.sizes.tolist(), strict=True):
            if size >= need:
                p = (np.arange(0, size, V)[:, None] + cover).ravel()
                found.append(start + p[p <= size - need])
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def suffixes(self, shared: np.ndarray, length: int) -> np.ndarray:
        """Positions with a sampled position of shared rank among their next V and ``length`` bytes left."""
        mark = np.zeros(len(self.text) + 1, np.int32)
        starts = self.ends - self.sizes
        first = np.maximum(shared - V + 1, starts[np.searchsorted(self.ends, shared, side="right")])
        np.add.at(mark, first, 1)
        np.add.at(mark, shared + 1, -1)
        near = np.cumsum(mark[:-1]) > 0
        for end, size in zip(self.ends.tolist(), self.sizes.tolist(), strict=True):
            near[max(end - size, end - length + 1) : end] = False
        return np.flatnonzero(near)


def _sorted(keys: np.ndarray, check: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys by (key, check), and which are equal to the one before."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if check is not None:
        differ = check[order[1:]] != check[order[:-1]]
        if (same & differ).any():  # a collision of the first 64 bits
            order = np.lexsort((check, keys))
            ranked = keys[order]
            same, differ = ranked[1:] == ranked[:-1], check[order[1:]] != check[order[:-1]]
        same &= ~differ
    return order, same


class _Keys:
    """Sorted distinct keys (64 bits, and 64 more where the last word counts), each key's place, and which occur twice."""

    def __init__(self, keys: np.ndarray, check: np.ndarray | None = None):
        order, same = _sorted(keys, check)
        new = np.ones(len(keys), bool)
        new[1:] = ~same
        number = np.cumsum(new) - 1
        self.place = np.empty(len(keys), np.int64)
        self.place[order] = number
        first = order[new]
        self.keys, self.check = keys[first], None if check is None else check[first]
        self.twice = np.bincount(number, minlength=len(first)) > 1


def _cells(blk: int, found: _Keys | None, buckets: int, low: int, high: int) -> pa.Table:
    """Sorted keys cut into buckets; each cell holds byte planes of their differences, the checks, and flags."""
    rows: list[tuple] = []
    if found is not None:
        edges = (np.arange(low, high + 1, dtype=object) * (1 << 32) + buckets - 1) // buckets
        top = (found.keys >> _U(32)).astype(np.int64)
        cuts = np.searchsorted(top, edges.astype(np.int64)).tolist()
        for k in range(high - low):
            a, b = cuts[k], cuts[k + 1]
            if a < b:
                steps = np.diff(found.keys[a:b], prepend=_U(0)).astype("<u8")
                planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()
                check = b"" if found.check is None else found.check[a:b].astype("<u8").tobytes()
                rows.append((low + k, blk, b - a, planes + check + np.packbits(found.twice[a:b]).tobytes()))
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["bucket", "blk", "n", "payload"])


def _resolve(cells: pa.Table) -> pa.Table:
    """One bucket sorted: for each block's keys, whether they repeat there or in another block."""
    keys, checks, flags, sizes = [], [], [], cells.column("n").to_pylist()
    for n, payload in zip(sizes, cells.column("payload").to_pylist(), strict=True):
        steps = np.ascontiguousarray(np.frombuffer(payload, np.uint8, 8 * n).reshape(8, n).T).view("<u8").ravel()
        keys.append(np.cumsum(steps, dtype=_U))
        mark = len(payload) - -(-n // 8)
        if mark > 8 * n:
            checks.append(np.frombuffer(payload, "<u8", n, 8 * n))
        flags.append(np.unpackbits(np.frombuffer(payload, np.uint8, offset=mark), count=n).astype(bool))
    order, same = _sorted(np.concatenate(keys), np.concatenate(checks) if checks else None)
    repeat = np.concatenate(flags)
    repeat[order[1:][same]] = True
    repeat[order[:-1][same]] = True
    ends = np.cumsum(sizes)
    bits = [np.packbits(repeat[e - n : e]).tobytes() for e, n in zip(ends.tolist(), sizes, strict=True)]
    return pa.table([cells.column("blk").cast(pa.int32()), cells.column("bucket").cast(pa.int32()), pa.array(bits, pa.binary())], ["blk", "bucket", "bits"])


def _answered(keys: np.ndarray, answers: dict[int, bytes], buckets: int) -> np.ndarray:
    """The bits that came back for a block's sorted distinct keys."""
    out = np.zeros(len(keys), bool)
    bucket = ((keys >> _U(32)) * _U(buckets)) >> _U(32)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(keys)]]) if len(keys) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = np.unpackbits(np.frombuffer(answers[int(bucket[a])], np.uint8), count=int(b - a)).astype(bool)
    return out


def _by_kind(answers: pa.Table) -> tuple[dict[int, bytes], dict[int, bytes]]:
    out: tuple[dict[int, bytes], dict[int, bytes]] = ({}, {})
    for kind, bucket, bits in zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "bits")), strict=True):
        out[kind][bucket] = bits
    return out


def _sample_keys(block: _Block, length: int) -> tuple[np.ndarray, _Keys]:
    at = block.sample(length)
    return at, _Keys(fingerprints(block.text, at, length - V + 1))


def _candidates(block: _Block, sample_bits: dict[int, bytes], buckets: int, length: int) -> np.ndarray:
    at, found = _sample_keys(block, length)
    return block.suffixes(at[_answered(found.keys, sample_bits, buckets)[found.place]], length)


def _suffix_keys(block: _Block, at: np.ndarray, length: int, buckets: int, low: int, high: int) -> _Keys:
    keys = fingerprints(block.text, at, length)
    if (low, high) != (0, buckets):
        bucket = ((keys >> _U(32)) * _U(buckets)) >> _U(32)
        here = (bucket >= low) & (bucket < high)
        at, keys = at[here], keys[here]
    return _Keys(keys, fingerprints(block.text, at, length, 1))


def _sample_cells(docs: pa.Table, buckets: int, length: int) -> pa.Table:
    return _cells(docs.column("_blk")[0].as_py(), _sample_keys(_Block(docs), length)[1], buckets, 0, buckets)


def _suffix_cells(docs: pa.Table, answers: pa.Table, sample_buckets: int, buckets: int, length: int, low: int, high: int) -> pa.Table:
    if not docs.num_rows:
        return _cells(0, None, buckets, low, high)
    block = _Block(docs)
    at = _candidates(block, _by_kind(answers)[0], sample_buckets, length)
    return _cells(docs.column("_blk")[0].as_py(), _suffix_keys(block, at, length, buckets, low, high), buckets, low, high)


def _suffix_task(sample_buckets: int, buckets: int, length: int, low: int, high: int):
    return lambda docs, answers: _suffix_cells(docs, answers, sample_buckets, buckets, length, low, high)


_DIGEST = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]


def _digests(sizes: np.ndarray, removed: np.ndarray, spans: np.ndarray, kept: list[bytes], texts: bool) -> dict[str, pa.Array]:
    out = dict(zip(_DIGEST, (pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])), strict=True))
    return out | {"text": pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())} if texts else out


def _marked(docs: pa.Table, answers: pa.Table, sample_buckets: int, buckets: int, length: int) -> tuple[_Block, np.ndarray]:
    """A block, and which of its bytes go."""
    block = _Block(docs)
    sample_bits, suffix_bits = _by_kind(answers)
    at = _candidates(block, sample_bits, sample_buckets, length)
    found = _suffix_keys(block, at, length, buckets, 0, buckets)
    at = at[_answered(found.keys, suffix_bits, buckets)[found.place]]
    mark = np.zeros(len(block.text) + 1, np.int32)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + length, -1)
    return block, np.cumsum(mark[:-1]) > 0


def _removed(docs: pa.Table, answers: pa.Table, sample_buckets: int, buckets: int, length: int, texts: bool) -> pa.Table:
    block, gone = _marked(docs, answers, sample_buckets, buckets, length)
    first = gone.copy()
    first[1:] &= ~gone[:-1]
    starts = block.ends - block.sizes
    heads = starts[block.sizes > 0]
    first[heads] = gone[heads]
    n_gone, n_first = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, first))
    n_removed, n_spans = n_gone[block.ends] - n_gone[starts], n_first[block.ends] - n_first[starts]
    kept = [t if not r else block.text[a:b][~gone[a:b]].tobytes() for t, r, a, b in zip(block.texts, n_removed.tolist(), starts.tolist(), block.ends.tolist(), strict=True)]
    columns = {"_row": docs.take(pa.array(block.order, pa.int64())).column("_row"), **_digests(block.sizes, n_removed, n_spans, kept, texts)}
    if "_part" not in docs.column_names:
        return pa.table(columns)
    parts = docs.take(pa.array(block.order, pa.int64())).select(["_key", "_part"])  # of pieces only the marked bytes count
    bits = [np.packbits(gone[a:b]).tobytes() if k is not None else None for k, a, b in zip(parts.column("_key").to_pylist(), starts.tolist(), block.ends.tolist(), strict=True)]
    return pa.table({**columns, "_key": parts.column("_key"), "_part": parts.column("_part"), "_bits": pa.array(bits, pa.binary())})


def _cut(batches: Iterator[pa.RecordBatch], size: int, length: int) -> Iterator[pa.RecordBatch]:
    """Long texts -> overlapping pieces, one at a time."""
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = memoryview(text.as_buffer())
            for part, s in enumerate(range(0, len(data) - length + 1, size)):
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([part], pa.int32()), pa.array([bytes(data[s : s + size + length - 1])], pa.binary())], ["_key", "_part", "_text"])


def _joined_up(docs: pa.Table, pieces: pa.Table, size: int, texts: bool) -> pa.Table:
    """One long text and the marked bytes of its pieces."""
    if not docs.num_rows:
        return docs.select(["_row"])
    data = np.frombuffer(docs.column("_text")[0].as_buffer(), np.uint8)
    gone = np.zeros(len(data), bool)
    for part, bits in zip(pieces.column("_part").to_pylist(), pieces.column("_bits").to_pylist(), strict=True):
        here = gone[part * size : part * size + 8 * len(bits)]
        here |= np.unpackbits(np.frombuffer(bits, np.uint8), count=len(here)).astype(bool)
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    columns = _digests(np.array([len(data)]), np.array([int(gone.sum())]), np.array([spans]), [data[~gone].tobytes()], texts)
    return pa.table({"_row": docs.column("_row"), **columns})


def substring_dedup(docs: DataFrame, length: int = LENGTH, texts: bool = True, block_bytes: int = BLOCK_BYTES, ranges: int = RANGES, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """Per row of ``docs``: ``_row`` (its ``columns``), n_bytes, n_removed, n_spans, kept_sha256 and, with ``texts``, the kept text."""
    if length < 2 * V:
        raise ValueError(f"length must be {2 * V} at least")
    columns = columns if columns is not None else [c for c in docs.columns if c != text_col]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    total, longest = (int(x or 0) for x in docs.agg(F.sum(F.octet_length(text)), F.max(F.octet_length(text))).first())
    blocks = max(1, -(-total // block_bytes))
    row = F.struct(*[F.col(f"`{c}`") for c in columns]) if columns else F.struct(F.lit(None).cast("string").alias("_"))
    rows = docs.select(row.alias("_row"), F.col(f"`{id_col}`").alias("_id"), text.cast("binary").alias("_text"))

    def to_block(*what) -> Column:
        return F.pmod(F.xxhash64(*what), F.lit(blocks)).cast("int").alias("_blk")

    dealt = rows.select("*", to_block("_id", "_text"))
    filled = dealt.select("_blk", F.octet_length("_text").alias("n")).where(F.col("n") <= max(block_bytes, 2 * length)).groupBy("_blk").agg(F.sum("n").alias("n"))
    if blocks > 1 and filled.where(F.col("n") > FULL_BLOCKS * block_bytes + 2 * length).limit(1).count():
        dealt = staged(rows.select("*", to_block(F.monotonically_increasing_id())), "dealt")
    long = None
    if longest > max(block_bytes, 2 * length):
        is_long = F.octet_length("_text") > max(block_bytes, 2 * length)
        # The staged table fixes the keys by which a text and its pieces meet again.
        long = staged(dealt.where(is_long).select(F.monotonically_increasing_id().alias("_key"), "_row", "_text"), "long-texts")
        pieces = long.select("_key", "_text").mapInArrow(lambda b: _cut(b, max(block_bytes, length), length), "_key long, _part int, _text binary")
        kind = dict(rows.dtypes)
        pieces = pieces.select(F.lit(None).cast(kind["_row"]).alias("_row"), F.lit(None).cast(kind["_id"]).alias("_id"), "_text", to_block("_key", "_part"), "_key", "_part")
        dealt = dealt.where(~is_long).withColumns({"_key": F.lit(None).cast("long"), "_part": F.lit(None).cast("int")}).unionByName(pieces)
    plain = dealt.select("_id", "_text", "_blk")

    sample_buckets, buckets = -(-blocks // SAMPLE_BLOCKS), -(-blocks // SUFFIX_BLOCKS)
    sample = plain.groupBy("_blk").applyInArrow(lambda d: _sample_cells(d, sample_buckets, length), _CELL)
    ranks = staged(sample.groupBy("bucket").applyInArrow(_resolve, ANSWER), "cover-ranks")
    answers = ranks.withColumn("kind", F.lit(0))
    for r in range(ranges):
        low, high = buckets * r // ranges, buckets * (r + 1) // ranges
        if low < high:
            asked = ranks.withColumn("kind", F.lit(0)).groupBy("blk")
            cells = plain.groupBy("_blk").cogroup(asked).applyInArrow(_suffix_task(sample_buckets, buckets, length, low, high), _CELL)
            answers = answers.unionByName(staged(cells.groupBy("bucket").applyInArrow(_resolve, ANSWER), "suffix-answers").withColumn("kind", F.lit(1)))
    digest = [*[T.StructField(n, T.StringType() if n == "kept_sha256" else T.LongType()) for n in _DIGEST], *([T.StructField("text", T.StringType())] if texts else [])]
    more = [T.StructField("_key", T.LongType()), T.StructField("_part", T.IntegerType()), T.StructField("_bits", T.BinaryType())] if long is not None else []
    out = dealt.groupBy("_blk").cogroup(answers.groupBy("blk")).applyInArrow(lambda d, a: _removed(d, a, sample_buckets, buckets, length, texts), T.StructType([dealt.schema["_row"], *digest, *more]))
    if long is None:
        return out
    out = staged(out, "marked")
    marked = out.where("_key is not null").select("_key", "_part", "_bits")
    whole = long.groupBy("_key").cogroup(marked.groupBy("_key")).applyInArrow(lambda d, p: _joined_up(d, p, max(block_bytes, length), texts), T.StructType([long.schema["_row"], *digest]))
    return out.where("_key is null").drop("_key", "_part", "_bits").unionByName(whole)


def dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the repeated substrings taken out of their texts."""
    out = substring_dedup(docs, length, id_col=id_col, text_col=text_col, **options)
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns])


def op1_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a 200-byte dedup removes from each of all ``documents``."""
    out = substring_dedup(table(spark, sf_dir, "documents"), texts=False, columns=["doc_id"])
    return out.select("_row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
