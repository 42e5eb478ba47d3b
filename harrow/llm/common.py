"""Helpers that the training-data operators share: tables, staging, size-checked joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.staging import drop_staged, scratch, staged

__all__ = ["attach", "drop_staged", "packed", "scratch", "staged", "table", "unpacked", "with_column"]

#: A side is broadcast only if a count proves that it has at most this many rows.
BROADCAST_ROWS = 10_000
#: Ways in which a hot join key is dealt out when the other side is too large to broadcast.
SALTS = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attach(df: DataFrame, small: DataFrame, key: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Left join of ``small`` (unique in ``key``): broadcast if counted small, else salted."""
    if small.limit(limit + 1).count() <= limit:
        return df.join(F.broadcast(small), key, "left")
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("_salt")
    dealt = df.withColumn("_salt", (F.rand(17) * SALTS).cast("int"))
    return dealt.join(small.select("*", salts), [key, "_salt"], "left").drop("_salt")


def packed(df: DataFrame, name: str = "_row") -> Column:
    """All columns of ``df`` as one struct, out of the way of the operator's own names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def unpacked(df: DataFrame, columns: list[str], name: str = "_row") -> list[Column]:
    """The columns that :func:`packed` put away."""
    return [F.col(name).getField(c).alias(c) for c in columns]


def with_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``name`` replaced in place, its columns in the same order."""
    return df.select(*[value.alias(c) if c == name else F.col(f"`{c}`") for c in df.columns])
