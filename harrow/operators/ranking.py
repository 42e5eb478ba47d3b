"""Ranks over a whole table or a few strata, without one task for each.

A window without a partition, or one over a few huge strata, sorts everything in a
few tasks. Here rows fall into buckets of a uniform hash or of a value range; the
buckets' sizes are summed up before each one, and rows are ranked within buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024


def seeded(*columns: Column | str, seed: int = 42) -> Column:
    """A hash that orders rows at random, but always alike."""
    return F.xxhash64(*columns, F.lit(seed))


def with_hash_rank(df: DataFrame, key: Column, strata: list[str], name: str = "rank", total: str | None = None, buckets: int = BUCKETS, ties: list[str] | None = None) -> DataFrame:
    """``df`` with each row's rank (from 1) in the order of ``key``, a uniform 64-bit hash, within its stratum."""
    shifted = df.withColumn("_key", key.bitwiseXOR(F.lit(-(2**63)))).withColumn("_bucket", (F.shiftrightunsigned("_key", 33) * buckets / F.lit(2**31)).cast("int"))
    sizes = shifted.groupBy(*strata, "_bucket").agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*strata).orderBy("_bucket")
    before = sizes.withColumn("_before", F.sum("_n").over(order) - F.col("_n"))
    if total:
        before = before.withColumn(total, F.sum("_n").over(Window.partitionBy(*strata)))
    within = Window.partitionBy(*strata, "_bucket").orderBy(F.shiftrightunsigned("_key", 1), F.col("_key").bitwiseAND(F.lit(1)), *(ties or []))
    # Strata and buckets are few; nulls are strata of their own.
    joined = shifted.withColumn("_within", F.row_number().over(within))
    renamed = before.drop("_n").withColumnsRenamed({c: f"_s{i}" for i, c in enumerate(strata)} | {"_bucket": "_b"})
    on = F.col("_bucket") == F.col("_b")
    for i, c in enumerate(strata):
        on = on & F.col(c).eqNullSafe(F.col(f"_s{i}"))
    out = joined.join(renamed, on)
    return out.withColumn(name, F.col("_before") + F.col("_within")).drop("_key", "_bucket", "_within", "_before", "_b", *[f"_s{i}" for i in range(len(strata))])


def hash_sample(df: DataFrame, n: int, *keys: str, seed: int = 42) -> DataFrame:
    """``n`` rows, chosen by hash."""
    return df.orderBy(seeded(*keys, seed=seed), *keys).limit(n)


def top_per_group(df: DataFrame, groups: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group; what is beyond is dropped before the shuffle."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def capped_selection(df: DataFrame, rank: list[Column], cap: int, most: int, least: int, group: str = "source", id_col: str = "record_id") -> DataFrame:
    """At most ``cap`` rows of each group and ``most`` in all, in rank order; filled up to ``least`` if there are fewer."""
    capped = top_per_group(df, [group], rank, cap, "_in_group").drop("_in_group").orderBy(*rank).limit(most)
    chosen = capped.withColumn("_refill", F.lit(0))
    rest = df.join(capped.select(id_col), id_col, "left_anti").orderBy(*rank).limit(least).withColumn("_refill", F.lit(1))
    few = chosen.unionByName(rest)
    # most + least rows at most
    numbered = few.withColumn("_n", F.row_number().over(Window.orderBy("_refill", *rank))).withColumn("_have", F.sum(1 - F.col("_refill")).over(Window.partitionBy()))
    return numbered.where((F.col("_refill") == 0) | (F.col("_n") <= least)).drop("_refill", "_n", "_have")


def group_split(df: DataFrame, group: str, stratum: str | None, shares: dict[str, float], seed: int = 42, name: str = "split") -> DataFrame:
    """``df`` with a split for whole groups, each stratum dealt out in the given shares."""
    strata = [stratum] if stratum else []
    groups = df.groupBy(group).agg(*([F.min(stratum).alias(stratum)] if stratum else []))
    ranked = with_hash_rank(groups, seeded(group, seed=seed), strata, "_rank", "_total", ties=[group])
    out, reached = None, 0.0
    for split, share in shares.items():
        reached += share
        within = F.col("_rank") <= F.round(F.col("_total") * round(reached, 9))
        out = F.when(within, split) if out is None else out.when(within, split)
    named = ranked.select(group, out.otherwise(list(shares)[-1]).alias(name))
    return df.join(named, group)


def split_leaks(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that are in more than one split."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(split).alias("split_count")).where("split_count > 1")
