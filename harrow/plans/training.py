"""Training sets: pairs, splits without leaks, group-safe baselines, counterfactual pilots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions.hashing import sha256
from harrow.functions.measures import reasons, word_count
from harrow.functions.normalize import key_letters, whitespace
from harrow.operators import dedup as D
from harrow.operators import models, pairs, ranking
from harrow.operators.components import components
from harrow.staging import spread, staged

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def pilot(df: DataFrame, record: str, text: str, source: str, cap: int = 250, most: int = 6000, least: int = 5000) -> DataFrame:
    """Pairs from texts of balanced sources, in an order that is a hash of their ids."""
    from harrow.functions.edits import has_fact, is_sensitive

    # Texts are tested once and chosen by their keys; the texts chosen, no more than both limits, are dealt out for the edits.
    keys = df.where(~is_sensitive(text) & has_fact(text)).select(record, source, sha256(F.col(record).cast("string")).alias("_rank"), F.xxhash64(text).alias("_text"))
    some = ranking.capped_selection(staged(keys, "pilot-keys"), [F.col("_rank"), F.col(record)], cap, most, least, source, record).select(F.col(record).alias("_record"), "_text")
    chosen = df.join(F.broadcast(some), F.col(record).eqNullSafe(F.col("_record")) & (F.xxhash64(text) == F.col("_text")), "left_semi")
    return pairs.counterfactual_pairs(spread(staged(chosen, "pilot-texts")), record, text, F.concat(F.lit("pilot_pair_"), F.col(record).cast("string")))


def paired_training_set(real: DataFrame, fake: DataFrame, pair: str, text: str, shares: dict[str, float] | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(rows of both texts of each pair with the pair's split, synthetic rows without a parent)."""
    both, unmatched = pairs.matched(fake.select(pair, F.col(text).alias("_fake"), "method"), real.select(pair, F.col(text).alias("_real"), "source"), pair)
    both = D.first_per_key(both, [pair], [F.col("_fake")])
    split = ranking.group_split(both, pair, "method", shares or SHARES, seed)
    real_row = F.struct(F.col("_real").alias("text"), F.lit("real").alias("label"), F.lit(0).alias("label_id"), F.lit(False).alias("is_synthetic"))
    fake_row = F.struct(F.col("_fake").alias("text"), F.lit("fake").alias("label"), F.lit(1).alias("label_id"), F.lit(True).alias("is_synthetic"))
    rows = split.select(pair, "source", "method", "split", F.explode(F.array(real_row, fake_row)).alias("x")).select(pair, "source", "method", "split", "x.*")
    return rows.withColumns({"text": whitespace("text"), "word_count": word_count("text")}), unmatched


def check_pairs(df: DataFrame, pair: str = "pair_id", split: str = "split") -> DataFrame:
    """``df``, or an error: two rows for each pair, one of each label, in one split, and no text in two."""
    broken = df.groupBy(pair).agg(F.count("*").alias("n"), F.count_distinct("label").alias("l"), F.count_distinct(split).alias("s")).where("n <> 2 or l <> 2 or s <> 1")
    leaks = ranking.split_leaks(df.withColumn("_key", sha256(F.lower(whitespace("text")))), "_key", split)
    for what, found in (("pairs", broken), ("texts", leaks)):
        if found.limit(1).count():
            raise ValueError(f"{what} break the split")
    return df


def length_matched_set(df: DataFrame, pair: str = "pair_id", text: str = "text") -> DataFrame:
    """The same pairs at equal length."""
    return pairs.length_matched(df, pair, text)


def duplicate_groups(df: DataFrame, record: str, key: str, links: DataFrame | None = None) -> DataFrame:
    """``df`` with a group for each record: equal keys and linked records are one."""
    heads = df.where(F.col(key) != "").groupBy(key).agg(F.min(record).alias("_head"))
    same = df.join(heads, key).where(F.col(record) != F.col("_head")).select(F.col("_head").alias("a"), F.col(record).alias("b"))
    edges = same.unionByName(links.select("a", "b")) if links is not None else same
    found = components(edges)
    joined = df.join(found.withColumnRenamed("id", record), record, "left")
    return D.first_seen_numbers(joined.withColumn("_root", F.coalesce("component", F.col(record))), "_root", record, "group_%06d", "split_group_id").drop("_root", "component")


def group_safe_split(df: DataFrame, group: str = "split_group_id", label: str = "label", shares: dict[str, float] | None = None, seed: int = 42) -> DataFrame:
    """Groups of one label dealt out whole; groups of several labels are left out."""
    pure = df.groupBy(group).agg(F.count_distinct(label).alias("_n")).where("_n = 1").select(group)
    return ranking.group_split(df.join(pure, group, "left_semi"), group, label, shares or {"train": 0.7, "validation": 0.15, "test": 0.15}, seed)


def split_summary(df: DataFrame, split: str = "split", label: str = "label", group: str = "split_group_id", text: str = "text") -> DataFrame:
    """For each split and label: rows, groups, mean length."""
    return df.groupBy(split, label).agg(F.count("*").alias("row_count"), F.count_distinct(group).alias("group_count"), F.round(F.avg(F.length(text)), 2).alias("mean_characters"))


def exclusion_reasons(df: DataFrame, flags: dict[str, str]) -> DataFrame:
    """``df`` with all exclusion flags that hold, joined, and whether any does."""
    why = reasons(*[(name, F.coalesce(F.col(c), F.lit(False))) for name, c in flags.items()])
    return df.withColumn("exclusion_reasons", F.array_join(why, ";")).withColumn("excluded", F.col("exclusion_reasons") != "")


def baselines(train: DataFrame, test: DataFrame, text: str = "text", label: str = "label", features: int = 100_000) -> DataFrame:
    """Metrics of logistic regression, linear SVM and length alone."""
    return baselines_on(train, {"test": test}, text, label, features).drop("test_set")


def baselines_on(train: DataFrame, tests: dict[str, DataFrame], text: str = "text", label: str = "label", features: int = 100_000) -> DataFrame:
    """The same for several test sets, by ``test_set``; the models are fitted once."""
    weights = models.TermWeights(features=features).fit(train, text)
    balanced = staged(models.balanced_weights(weights.transform(train, text), label), "train-features")
    lr, svm, length = models.logistic(balanced, label, weight="weight"), models.linear_svm(balanced, label), models.length_baseline(train, text, label)
    out = None
    for test_set, test in tests.items():
        b = weights.transform(test, text)
        named = {"tfidf_logistic": lr.transform(b), "tfidf_svm": svm.transform(b), "length_only": length.transform(test.withColumn("_words", word_count(text).cast("double")))}
        for name, predictions in named.items():
            # Three numbers a row are written, so that the metrics' passes do not score again.
            scored = staged(models.positive_score(predictions).select(label, "prediction", "fake_probability"), "scored")
            row = models.evaluated(scored, label).withColumns({"model": F.lit(name), "test_set": F.lit(test_set)})
            out = row if out is None else out.unionByName(row)
    return out


def external_baselines(train: DataFrame, external: DataFrame, record: str, text: str = "text", label: str = "label", features: int = 100_000) -> DataFrame:
    """Baselines on a group-safe split and on an external set: metrics by ``test_set``.

    Training rows whose text the external set has too are left out, by one key for
    both; equal texts never lie on both sides of the split.
    """
    keyed = train.withColumn("_key", sha256(key_letters(text)))
    theirs = external.select(sha256(key_letters(text)).alias("_key")).distinct()
    clean = keyed.join(theirs, "_key", "left_anti")
    split = staged(group_safe_split(duplicate_groups(clean, record, "_key").drop("_key"), label=label), "external-split")
    return baselines_on(split.where("split = 'train'"), {"internal": split.where("split <> 'train'"), "external": external}, text, label, features)
