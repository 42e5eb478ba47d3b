"""Exact duplicates: who stays, how large groups are, how they are named and reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions.measures import preview
from harrow.staging import drop_staged, staged

#: Rows of a key from which on its ranks are computed over ranges, and not in one task.
HOT_ROWS = 1_000_000
RANGES = 64


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in ``order``; a reduction, so that a hot key is no hot task."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    ranked = df.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("_o"), row.alias("_row"))
    best = ranked.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.min_by("_row", "_o").alias("_row"))
    return best.select("_row.*")


def ranked_duplicates(df: DataFrame, keys: list[str], order: list[Column], prefix: str = "dedup", hot: int = HOT_ROWS) -> DataFrame:
    """``df`` with rank and size of each row's group, and whether it is the one to keep.

    Groups of more than ``hot`` rows are ranked range by range; null keys are a
    group of their own.
    """
    w = Window.partitionBy(*keys)
    rank, size = f"{prefix}_rank", f"{prefix}_group_size"
    large = df.groupBy(*keys).agg(F.count("*").alias(size)).where(F.col(size) > hot)
    large = staged(large, "hot-keys")
    if large.limit(1).count():
        same = lambda: [F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in keys]
        every, few = df.alias("_l"), large.alias("_r")
        rest = every.join(few, same(), "left_anti")
        some = _ranked_by_range(every.join(few, same()).select("_l.*", size), keys, order, rank)
        out = rest.withColumns({rank: F.row_number().over(w.orderBy(*order)), size: F.count("*").over(w)}).unionByName(some)
    else:
        drop_staged(large)
        out = df.withColumns({rank: F.row_number().over(w.orderBy(*order)), size: F.count("*").over(w)})
    return out.withColumn(f"{prefix}_keep", F.col(rank) == 1)


def _ranked_by_range(df: DataFrame, keys: list[str], order: list[Column], name: str, ranges: int = RANGES) -> DataFrame:
    """``df`` ranked within its keys: parts of the order are ranked alone, after the key's rows in the parts before."""
    sort = [*[F.col(k) for k in keys], *order]
    # The staged table fixes the parts, whose bounds are drawn from a sample.
    parts = staged(df.repartitionByRange(ranges, *sort).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_n")).drop("_n")
    on = [F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in [*keys, "_part"]]
    within = Window.partitionBy(*keys, "_part").orderBy(*order)
    numbered = parts.withColumn("_within", F.row_number().over(within)).alias("_l")
    out = numbered.join(before.alias("_r"), on).select("_l.*", "_before")
    return out.withColumn(name, (F.col("_within") + F.col("_before")).cast("int")).drop("_within", "_before", "_part")


def with_occurrence(df: DataFrame, keys: list[str], order: list[Column], name: str = "occurrence") -> DataFrame:
    """``df`` with the number of times that a row's key has occurred so far."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def with_group_facts(df: DataFrame, key: str, distinct: dict[str, str], size: str = "group_size") -> DataFrame:
    """``df`` with the size of each row's group and distinct counts of columns in it, nulls ignored.

    The facts are aggregated first and joined back, so that they combine before the shuffle.
    """
    facts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(size), *[F.count_distinct(c).alias(name) for name, c in distinct.items()])
    return df.join(facts, key, "left")


def duplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key occurs more than once."""
    many = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return df.join(many, keys, "left_semi")


def group_names(df: DataFrame, key: str, pattern: str, name: str = "group_id") -> DataFrame:
    """``df`` with a numbered name for each key, in code point order.

    Only distinct keys are numbered, and over ranges of them at once.
    """
    return df.join(numbered_keys(df.select(key).where(F.col(key).isNotNull()).distinct(), [F.col(key)], pattern, name), key, "left")


def numbered_keys(keys: DataFrame, order: list[Column], pattern: str | None, name: str, ranges: int = RANGES) -> DataFrame:
    """Distinct rows numbered from 1 in ``order``, part by part."""
    # The staged table fixes the parts, whose bounds are drawn from a sample; it is read twice.
    parts = staged(keys.repartitionByRange(ranges, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before")
    out = parts.join(before, "_part").withColumn(name, number)
    return (out.withColumn(name, F.format_string(pattern, F.col(name))) if pattern else out).drop("_part", "_before")


def first_seen_numbers(df: DataFrame, group: str, order: str, pattern: str, name: str = "group_id") -> DataFrame:
    """``df`` with groups numbered by their first row's place."""
    firsts = df.groupBy(group).agg(F.min(order).alias("_first"))
    return df.join(numbered_keys(firsts, [F.col("_first"), F.col(group)], pattern, name).drop("_first"), group)


def duplicate_report(df: DataFrame, key: str, record: str, dataset: str, source: str, label: str, text: str, pattern: str = "exact_%05d") -> DataFrame:
    """Rows of groups of more than one, with the group's name, size, data sets, labels and conflict.

    Keys are computed once. Groups are told apart by 128 bits of their key, so that
    texts themselves move only for rows of groups of more than one.
    """
    rows = df.where(F.col(key) != "").select(
        F.md5(F.col(key).cast("binary")).alias("_h"), F.col(dataset).alias("analysis_dataset"), F.col(record).alias("record_id"), F.col(source).alias("source"),
        F.col(label).alias("label_standard"), preview(text).alias("text_preview"), F.col(key).alias("comparison_text"),
    )
    rows = staged(rows, "keyed")
    sizes = {"group_dataset_count": "analysis_dataset", "group_label_count": "label_standard"}
    facts = rows.groupBy("_h").agg(F.count("*").alias("group_size"), *[F.count_distinct(c).alias(n) for n, c in sizes.items()]).where("group_size > 1")
    some = staged(rows.join(facts, "_h"), "repeated")
    drop_staged(rows)
    names = numbered_keys(some.groupBy("_h").agg(F.min("comparison_text").alias("_k")), [F.col("_k")], pattern, "exact_group_id").drop("_k")
    return some.join(names, "_h").select(
        "exact_group_id", "group_size", *sizes, (F.col("group_label_count") > 1).alias("has_label_conflict"), "analysis_dataset", "record_id", "source", "label_standard", "text_preview", "comparison_text",
    )


def group_labels(df: DataFrame, key: str, value: str) -> DataFrame:
    """How many groups have each set of values, named by the sorted set."""
    sets = df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(value)), " + ").alias("values"))
    return sets.groupBy("values").agg(F.count("*").alias("group_count"))


def choose_representatives(df: DataFrame) -> DataFrame:
    """Of equal texts keep the good one, of the smaller category, of known source, the longest, the first."""
    df = staged(df, "candidates")  # read three times
    sizes = df.groupBy("category_original").agg(F.count("*").alias("_category_size"))
    with_sizes = df.join(sizes, "category_original", "left")
    order = [
        (F.col("quality_status") != "quality_candidate").cast("int").asc(), F.col("_category_size").asc_nulls_last(), (F.lower("source") == "unknown").cast("int").asc(),
        F.col("word_count").desc(), F.col("record_id").asc(),
    ]
    out = ranked_duplicates(with_sizes, ["exact_text_hash"], order).drop("_category_size")
    action = F.when(~F.col("dedup_keep"), "exclude_exact_duplicate").when(F.col("dedup_group_size") > 1, "keep_exact_group_representative").otherwise("keep_unique")
    return out.withColumn("deduplication_action", action)


def overlap(left: DataFrame, right: DataFrame, key: str, suffixes: tuple[str, str] = ("_left", "_right"), one_to_one: bool = False) -> DataFrame:
    """Rows of two frames with the same key; with ``one_to_one``, a repeated key is an error."""
    if one_to_one:
        for side in (left, right):
            if side.groupBy(key).count().where("count > 1").limit(1).count():
                raise ValueError(f"{key} is not unique")
    a = left.withColumnsRenamed({c: c + suffixes[0] for c in left.columns if c != key and c in right.columns})
    b = right.withColumnsRenamed({c: c + suffixes[1] for c in right.columns if c != key and c in left.columns})
    return a.join(b, key)
