"""Content hashes, shingles, SimHash and its bands."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.functions.normalize import SLICE, WORD, ColumnOrName, text
from harrow.functions.structs import struct_of

SHINGLE, MOST_SHINGLES = 3, 64
BANDS, BAND_BITS = 4, 16
#: Prepended to a string, these bytes make a CRC start from the second seed, 0x9E3779B9.
SECOND_SEED = bytes.fromhex("C3C05F01")


@F.pandas_udf(T.StringType())
def blake2b_128(s: pd.Series) -> pd.Series:
    """16-byte BLAKE2b digest, in hexadecimal."""
    return s.map(lambda x: None if x is None else hashlib.blake2b(x.encode(), digest_size=16).hexdigest())


@F.pandas_udf(T.DecimalType(20, 0))
def blake2b_rank(s: pd.Series) -> pd.Series:
    """8-byte BLAKE2b digest as an unsigned number."""
    from decimal import Decimal

    return s.map(lambda x: None if x is None else Decimal(int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big")))


def sha256(c: ColumnOrName) -> Column:
    return F.sha2(text(c).cast("binary"), 256)


def sha1(c: ColumnOrName) -> Column:
    return F.sha1(text(c).cast("binary"))


def feature_hash(c: Column) -> Column:
    """64 bits: the CRC-32 of a string above its CRC-32 from the second seed."""
    raw = F.encode(c, "UTF-8")
    return F.shiftleft(F.crc32(raw), 32).bitwiseOR(F.crc32(F.concat(F.lit(SECOND_SEED), raw)))


def shingles(words: Column, size: int = SHINGLE, most: int = MOST_SHINGLES) -> Column:
    """Word n-grams, at most ``most`` of them at even distances; the words if there are fewer than n."""
    n = F.size(words) - (size - 1)
    step = (n - 1).cast("double") / F.lit(float(most - 1))
    at = F.when(n <= most, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(
        F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.when(i == most - 1, n - 1).otherwise(F.floor(i * step).cast("int")))
    )
    grams = F.transform(at, lambda i: F.array_join(F.slice(words, i + 1, size), " "))
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).when(n < 1, words).otherwise(grams)


def simhash_of(features: Column) -> Column:
    """A bit is set if at least half of the features' hashes have it set.

    Eight bits are counted at once: a table spreads a byte's bits over the bytes of
    a word, and words add up as long as there are fewer than 256 features, which
    should be a column and not an expression.
    """
    n = F.size(features)
    spread = F.array(*[F.lit(sum(1 << (8 * j) for j in range(8) if b >> j & 1)).cast("long") for b in range(256)])
    zero = F.struct(*[F.lit(0).cast("long").alias(f"c{k}") for k in range(8)])

    def add(acc: Column, h: Column) -> Column:
        byte = [F.shiftrightunsigned(h, 8 * k).bitwiseAND(F.lit(255)).cast("int") for k in range(8)]
        return F.struct(*[(acc[f"c{k}"] + F.get(spread, byte[k])).alias(f"c{k}") for k in range(8)])

    def pack(acc: Column) -> Column:
        out = F.lit(0).cast("long")
        for k in range(8):
            for j in range(8):
                count = F.shiftrightunsigned(acc[f"c{k}"], 8 * j).bitwiseAND(F.lit(255))
                out = out.bitwiseOR(F.when(count * 2 >= n, F.shiftleft(F.lit(1).cast("long"), 8 * k + j)).otherwise(F.lit(0).cast("long")))
        return out

    return F.when(n == 0, F.lit(0).cast("long")).otherwise(F.aggregate(F.transform(features, feature_hash), zero, add, pack))


def feature_words(words: list[str], size: int = SHINGLE, most: int = MOST_SHINGLES) -> list[str]:
    """:func:`shingles` of a list."""
    n = len(words) - (size - 1)
    if n < 1:
        return words
    step = (n - 1) / float(most - 1)
    at = range(n) if n <= most else [*(int(i * step) for i in range(most - 1)), n - 1]
    return [" ".join(words[i : i + size]) for i in at]


def simhash_number(features: list[str]) -> int:
    """:func:`simhash_of` a list."""
    raw = [f.encode() for f in features]
    if not raw:
        return 0
    seed = zlib.crc32(SECOND_SEED)
    hashes = np.array([zlib.crc32(r) << 32 | zlib.crc32(r, seed) for r in raw], "<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(len(raw), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 >= len(raw), bitorder="little").view("<i8")[0])


@F.arrow_udf(struct_of("simhash long, word_count int"))
def simhash_udf(a: pa.Array) -> pa.Array:
    """SimHash of a text's words, and how many they are; a text is one string here, not a list of words in the JVM."""
    found, out = re.compile(WORD).findall, ([], [])
    for i in range(0, len(a), SLICE):
        for x in a.slice(i, SLICE).to_pylist():
            words = found(x or "")
            out[0].append(simhash_number(feature_words(words)))
            out[1].append(len(words))
    return pa.StructArray.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32())], ["simhash", "word_count"])


def hex64(h: Column) -> Column:
    return F.lpad(F.lower(F.hex(h)), 16, "0")


def bands(h: Column, count: int = BANDS, bits: int = BAND_BITS) -> Column:
    """Band keys: the band's number above its bits."""
    mask = (1 << bits) - 1
    return F.array(*[F.shiftrightunsigned(h, i * bits).bitwiseAND(F.lit(mask)).bitwiseOR(F.lit(i << bits)) for i in range(count)])


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
