"""Distributions, profiles, counters, cross tables and n-gram reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions.measures import share
from harrow.staging import staged


def distribution(df: DataFrame, column: str, nulls: bool = False, digits: int = 4) -> DataFrame:
    """(value, count, percentage) of a column."""
    rows = df if nulls else df.where(F.col(column).isNotNull())
    counts = rows.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("count"))
    total = rows.agg(F.count("*").alias("_all"))  # one row
    return counts.join(F.broadcast(total)).withColumn("percentage", F.round(100 * F.col("count") / F.col("_all"), digits)).drop("_all")


def reason_distribution(df: DataFrame, column: str, joint: str = ";") -> DataFrame:
    """How often each reason of a joined list occurs."""
    one = F.explode(F.split(column, joint))
    return df.where(F.coalesce(F.col(column), F.lit("")) != "").select(one.alias("reason")).groupBy("reason").agg(F.count("*").alias("count"))


def column_profile(df: DataFrame) -> DataFrame:
    """For each column: filled and empty rows and their percentage, in one pass."""
    filled = [F.count_if(F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) != "").alias(f"n{i}") for i, c in enumerate(df.columns)]
    row = df.agg(F.count("*").alias("total"), *filled)
    lines = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("filled")) for i, c in enumerate(df.columns)])
    out = row.select("total", F.explode(lines).alias("x")).select("x.column_name", F.col("x.filled").alias("non_empty_count"), (F.col("total") - F.col("x.filled")).alias("empty_count"), "total")
    return out.select("column_name", "non_empty_count", "empty_count", F.round(100 * share(F.col("non_empty_count"), F.col("total")), 4).alias("non_empty_percentage"))


def metrics_table(row: DataFrame) -> DataFrame:
    """(metric, value) lines of a one-row frame."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in row.columns])
    return row.select(F.explode(pairs).alias("x")).select("x.*")


def threshold_counts(df: DataFrame, count: str, thresholds: tuple[int, ...] = (20, 50, 80, 120, 200), unique: str | None = None) -> DataFrame:
    """Rows, and first occurrences of a key, that reach each threshold.

    With a key, its values' digests alone are grouped, each with its rows' numbers and
    its greatest count, so that neither a window nor a second reading is needed.
    """
    reach = [F.count_if(F.col(count) >= t) for t in thresholds]
    if unique:
        keyed = df.select(F.sha2(F.col(unique).cast("string").cast("binary"), 256).alias("_key"), count)
        firsts = keyed.groupBy("_key").agg(F.max(count).alias(count), *[x.alias(f"r{t}") for x, t in zip(reach, thresholds, strict=True)])
        row = firsts.agg(*[F.coalesce(F.sum(f"r{t}"), F.lit(0)).alias(f"t{t}") for t in thresholds], *[x.alias(f"u{t}") for x, t in zip(reach, thresholds, strict=True)])
    else:
        row = df.agg(*[x.alias(f"t{t}") for x, t in zip(reach, thresholds, strict=True)])
    lines = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{t}").alias("row_count"), *([F.col(f"u{t}").alias("unique_count")] if unique else [])) for t in thresholds])
    return row.select(F.explode(lines).alias("x")).select("x.*")


def quantiles(df: DataFrame, column: str, at: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99), exact: bool = True) -> DataFrame:
    """(quantile, value); exact values are interpolated, approximate ones bound memory on many distinct values."""
    points = F.array(*[F.lit(a) for a in at])
    value = F.percentile(column, points) if exact else F.percentile_approx(column, points, 10_000)
    return df.agg(value.alias("v")).select(F.explode(F.arrays_zip(points.alias("quantile"), F.col("v").alias("value"))).alias("x")).select("x.quantile", F.col("x.value").cast("long").alias("value"))


def described(df: DataFrame, column: str, groups: list[str] | None = None, digits: int = 2) -> DataFrame:
    """count, mean, std, min, quartiles and max."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*(groups or [])).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).cast("double").alias("min"), q.alias("q"), F.max(column).cast("double").alias("max"))
    out = out.select(*(groups or []), "n", "mean", "std", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")
    return out.select(*(groups or []), "n", *[F.round(c, digits).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


def group_summary(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """count, mean, median, min and max of a value for each group; null keys left out."""
    some = df
    for g in groups:
        some = some.where(F.col(g).isNotNull())
    return some.groupBy(*groups).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.median(value), 6).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"))


def cross_table(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of row values by column values."""
    return df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row).pivot(column, values).count().fillna(0)


def pattern_report(df: DataFrame, groups: list[str], text: str, patterns: dict[str, str], digits: int = 2) -> DataFrame:
    """How many texts of each group match each pattern; all patterns in one pass."""
    value = F.coalesce(F.col(text), F.lit(""))
    counted = df.groupBy(*groups).agg(F.count("*").alias("group_size"), *[F.count_if(value.rlike(p)).alias(f"p{i}") for i, p in enumerate(patterns.values())])
    lines = F.array(*[F.struct(F.lit(n).alias("pattern_name"), F.col(f"p{i}").alias("match_count")) for i, n in enumerate(patterns)])
    out = counted.select(*groups, "group_size", F.explode(lines).alias("x")).select(*groups, "group_size", "x.*").where("match_count > 0")
    return out.withColumn("match_rate", F.round(100 * F.col("match_count") / F.col("group_size"), digits))


def word_ngrams(words: Column, lengths: tuple[int, ...] = (1, 2, 3)) -> Column:
    """The distinct n-grams of a list of words, which should be a column and not an expression."""
    def grams(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
        found = F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, found).otherwise(F.array().cast("array<string>"))

    every = [grams(n) for n in lengths]
    return F.array_distinct(F.flatten(F.array(*every)))


#: Buckets of n-grams whose sizes rule out most of them.
NGRAM_BUCKETS = 1 << 20


def discriminative_ngrams(df: DataFrame, group: str, text: str, top: int = 30, least_docs: int = 20, least_rate: float = 0.02, most_df: float = 0.98, pattern: str = r"(?U)\b\w\w+\b") -> DataFrame:
    """n-grams that are in a greater share of a group's texts than of the others', the clearest first.

    n-grams fall into buckets by their hash, and an n-gram is in no more of a group's
    texts than its bucket has n-grams there. Only n-grams of buckets that reach
    ``least_rate`` in some group can be in the answer; these are few, and only they are
    counted themselves. Groups' sizes are few.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(f"({pattern})"), F.lit(1))
    rows = df.where(F.col(group).isNotNull()).select(group, words.alias("_words"))
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("group_docs"))
    every = F.sum("group_docs").over(Window.partitionBy())
    sizes = sizes.withColumn("other_docs", every - F.col("group_docs")).withColumn("all_docs", every).where((F.col("group_docs") >= least_docs) & (F.col("other_docs") >= least_docs))
    sizes = staged(sizes.coalesce(1), "group-sizes")
    ngrams = rows.select(group, F.explode(word_ngrams(F.col("_words"))).alias("ngram"))
    bucket = lambda n: F.pmod(F.xxhash64(n), F.lit(NGRAM_BUCKETS)).cast("int")
    loads = ngrams.select(group, bucket("ngram").alias("_bucket")).groupBy(group, "_bucket").agg(F.count("*").alias("_load"))
    full = loads.join(F.broadcast(sizes), group).where(F.col("_load") >= F.col("group_docs") * least_rate * (1 - 1e-9)).select("_bucket").distinct()
    full = staged(full, "full-buckets")
    some = ngrams.withColumn("_bucket", bucket("ngram")).join(F.broadcast(full), "_bucket", "left_semi").drop("_bucket")
    counts = staged(some.groupBy("ngram", group).agg(F.count("*").alias("group_df")), "ngrams")
    totals = counts.groupBy("ngram").agg(F.sum("group_df").alias("all_df"))
    joined = counts.join(totals, "ngram").join(F.broadcast(sizes), group)
    least_df = F.greatest(F.lit(2), F.least(F.lit(20), F.round(0.001 * F.col("all_docs"))))
    kept = joined.where((F.col("all_df") >= least_df) & (F.col("all_df") <= most_df * F.col("all_docs")))
    rates = kept.withColumns({"group_rate": F.col("group_df") / F.col("group_docs"), "other_rate": (F.col("all_df") - F.col("group_df")) / F.col("other_docs")})
    rates = rates.withColumn("difference", F.round(F.col("group_rate") - F.col("other_rate"), 6)).where((F.col("group_rate") >= least_rate) & (F.col("difference") > 0))
    w = Window.partitionBy(group).orderBy(F.col("difference").desc(), F.col("group_df").desc(), "ngram")
    out = rates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return out.select(group, "rank", "ngram", "group_df", F.round("group_rate", 6).alias("group_rate"), F.round("other_rate", 6).alias("other_rate"), "difference")


def first_available_distributions(df: DataFrame, families: dict[str, tuple[str, ...]], blank: str = "BOŞ") -> DataFrame:
    """Distribution of the first column that is there of each family; blanks are counted by name."""
    from harrow.operators.schema import find_column

    out = None
    for family, names in families.items():
        column = find_column(df.columns, names)
        if column:
            value = F.coalesce(F.nullif(F.trim(F.col(column).cast("string")), F.lit("")), F.lit(blank))
            part = distribution(df.select(value.alias("v")), "v", digits=2).withColumns({"family": F.lit(family), "column_name": F.lit(column)})
            out = part if out is None else out.unionByName(part)
    return out


def distinct_over(df: DataFrame, *columns: str) -> DataFrame:
    """How many different values some columns hold together."""
    return df.select(F.explode(F.array(*columns)).alias("v")).agg(F.count_distinct("v").alias("distinct_count"))
