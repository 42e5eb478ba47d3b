"""Pairs of a real text and its synthetic variant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions.edits import counterfactual_udf, folded_difference_udf, has_fact, is_sensitive
from harrow.functions.measures import length_ratio, reasons, truncated, word_count
from harrow.functions.normalize import key_fact, strip
from harrow.functions.records import truth
from harrow.staging import over_all

LONGEST, SHORTEST = 200, 80


def matched(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``left`` with their match, and those without one."""
    return left.join(right, key), left.join(right.select(key), key, "left_anti")


def wide_pairs(df: DataFrame, pair: str, role: Column, columns: list[str]) -> DataFrame:
    """One row for each pair that has exactly one real and one fake row; one aggregation, no self-join."""
    row = F.struct(*columns)
    grouped = df.groupBy(pair).agg(F.count("*").alias("_n"), F.count_if(role == "real").alias("_real"), F.count_if(role == "fake").alias("_fake"), F.max(F.when(role == "real", row)).alias("real"), F.max(F.when(role == "fake", row)).alias("fake"))
    whole = grouped.where("_n = 2 and _real = 1 and _fake = 1")
    return whole.select(pair, *[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("real", "fake") for c in columns])


def length_matched(df: DataFrame, pair: str = "pair_id", text: str = "text", longest: int = LONGEST, shortest: int = SHORTEST) -> DataFrame:
    """Both texts of a pair cut to their common number of words; too short pairs dropped."""
    counted = df.withColumn("original_word_count", word_count(text))
    limit = F.least(F.min("original_word_count").over(Window.partitionBy(pair)), F.lit(longest))
    out = counted.withColumn("matched_word_count", limit).where(F.col("matched_word_count") >= shortest)
    return out.withColumns({text: truncated(text, F.col("matched_word_count")), "was_truncated": F.col("original_word_count") > F.col("matched_word_count")})


def with_edits(df: DataFrame, record: str, text: str) -> DataFrame:
    """Eligible texts with their edit; those that no edit changes are dropped."""
    some = df.where(~is_sensitive(text) & has_fact(text))
    return some.withColumn("edit", counterfactual_udf(F.col(text), F.col(record).cast("string"))).where("edit.text is not null")


def counterfactual_pairs(df: DataFrame, record: str, text: str, pair: Column, pairs: int | None = None) -> DataFrame:
    """Two rows for each text that an edit changes: itself and its variant."""
    edited = with_edits(df, record, text)
    if pairs:
        edited = edited.orderBy(record).limit(pairs)
    edited = edited.withColumn("pair_id", pair)
    parent = F.col(record).cast("string")
    empty = F.lit("")
    real = F.struct(parent.alias("record_id"), empty.alias("parent_record_id"), F.lit("real").alias("label_standard"), F.lit("real_parent").alias("pair_role"), F.col(text).alias("text_basic"), F.lit(False).alias("is_synthetic"), *[empty.alias(c) for c in ("edit_type", "original_fact", "modified_fact", "edit_context")])
    fake = F.struct(F.concat(F.col("pair_id"), F.lit("_fake")).alias("record_id"), parent.alias("parent_record_id"), F.lit("fake").alias("label_standard"), F.lit("synthetic_child").alias("pair_role"), F.col("edit.text").alias("text_basic"), F.lit(True).alias("is_synthetic"), *[F.col(f"edit.{c}").alias(c) for c in ("edit_type", "original_fact", "modified_fact", "edit_context")])
    return edited.select("pair_id", F.col("pair_id").alias("split_group_id"), F.explode(F.array(real, fake)).alias("x")).select("pair_id", "split_group_id", "x.*")


LOCATION_REASONS = ("original_fact_not_found_in_real", "modified_fact_not_found_in_fake")


def audited_pairs(df: DataFrame) -> DataFrame:
    """(pair_id, length_ratio, token_similarity, changed_token_count, quality_status, quality_reasons)."""
    row = F.struct("record_id", "parent_record_id", "split_group_id", F.col("is_synthetic").cast("string").alias("is_synthetic"), "text_basic", "original_fact", "modified_fact")
    label = F.col("label_standard")
    pairs = df.where("pair_id is not null").groupBy("pair_id").agg(F.count("*").alias("n"), F.count_if(label == "real").alias("reals"), F.count_if(label == "fake").alias("fakes"), F.max(F.when(label == "real", row)).alias("r"), F.max(F.when(label == "fake", row)).alias("f"))
    counts = reasons(("pair_record_count_not_two", F.col("n") != 2), ("real_record_count_not_one", F.col("reals") != 1), ("fake_record_count_not_one", F.col("fakes") != 1))
    real, fake = strip(F.coalesce("r.text_basic", F.lit(""))), strip(F.coalesce("f.text_basic", F.lit("")))
    before, after = key_fact("f.original_fact"), key_fact("f.modified_fact")
    found = reasons(
        ("empty_real_text", real == ""), ("empty_fake_text", fake == ""), ("real_and_fake_identical", real == fake), ("fake_not_marked_synthetic", ~truth("f.is_synthetic")), ("real_marked_synthetic", truth("r.is_synthetic")),
        ("parent_record_id_mismatch", ~F.col("f.parent_record_id").eqNullSafe(F.col("r.record_id"))), ("split_group_mismatch", ~F.col("r.split_group_id").eqNullSafe(F.col("f.split_group_id"))),
        ("missing_original_fact", before == ""), ("original_fact_not_found_in_real", (before != "") & ~F.contains(key_fact(real), before)),
        ("missing_modified_fact", after == ""), ("modified_fact_not_found_in_fake", (after != "") & ~F.contains(key_fact(fake), after)), ("original_and_modified_fact_same", (before != "") & (before == after)),
    )
    judged = over_all(pairs, "pair_id").withColumns({"counts": counts, "found": found, "ratio": length_ratio(F.length(real), F.length(fake)), "diff": folded_difference_udf(real, fake)})
    review = reasons(("low_length_ratio", F.col("ratio") < 0.95), ("low_token_similarity", F.col("diff.similarity") < 0.90), ("too_many_changed_tokens", F.col("diff.changed") > 8))
    broken = F.size("counts") > 0
    structural = F.filter("found", lambda x: ~x.isin(*LOCATION_REASONS))
    status = F.when(broken | (F.size(structural) > 0), "rejected").when((F.size("found") > 0) | (F.size(review) > 0), "review_required").otherwise("accepted_auto")
    every = F.when(broken, F.col("counts")).otherwise(F.concat("found", review))
    return judged.select(
        "pair_id", F.when(~broken, F.round("ratio", 5)).alias("length_ratio"), F.when(~broken, F.round("diff.similarity", 5)).alias("token_similarity"), F.when(~broken, F.col("diff.changed")).alias("changed_token_count"),
        status.alias("quality_status"), F.array_join(every, ";").alias("quality_reasons"),
    )
