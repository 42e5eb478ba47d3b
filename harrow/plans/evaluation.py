"""Studies of predictions: thresholds, false negatives, pair differences, scored pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions import measures as M
from harrow.functions.edits import difference_udf
from harrow.functions.pages import PAGES_AT_ONCE, detected_articles
from harrow.operators import chunks, metrics, reports
from harrow.staging import over_all, staged


def joined_predictions(predictions: DataFrame, rows: DataFrame, index: str = "original_index") -> DataFrame:
    """Predictions with their test rows, one to one; an error if one is missing or the counts differ."""
    if predictions.count() != rows.count() or predictions.join(rows, index, "left_anti").limit(1).count():
        raise ValueError("predictions and test rows do not match")
    return predictions.join(rows, index)


def verification(df: DataFrame, truth: str, predicted: str, score: str, expected: dict[str, float], tolerance: float = 0.005) -> DataFrame:
    """(metric, value, expected, within_tolerance)."""
    row = metrics.scores(metrics.confusion(df, truth, predicted)).join(F.broadcast(metrics.roc_auc(df, truth, score)))
    wanted = df.sparkSession.createDataFrame(list(expected.items()), "metric string, expected double")
    return reports.metrics_table(row).join(F.broadcast(wanted), "metric").withColumn("within_tolerance", F.abs(F.col("value") - F.col("expected")) <= tolerance)


def threshold_study(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(threshold table, recommendations)."""
    table = metrics.threshold_table(df)
    return table, metrics.recommendations(table)


def false_negatives(df: DataFrame, truth: str = "true_label", predicted: str = "predicted_label", confidence: str = "confidence", tokens: str = "token_count") -> DataFrame:
    """Missed fakes with their bands and review priority."""
    some = df.where((F.col(truth) == 1) & (F.col(predicted) == 0))
    return some.withColumns({"confidence_band": M.confidence_band(F.col(confidence)), "token_band": M.token_band(F.col(tokens)), "review_priority": M.review_priority(F.col(confidence))})


def pair_differences(wide: DataFrame, pair: str = "pair_id", real: str = "real_text", fake: str = "fake_text") -> DataFrame:
    """What differs between the texts of each pair, and the size of the edit."""
    out = over_all(wide, pair).withColumn("_d", difference_udf(F.col(real), F.col(fake)))
    return out.select(*wide.columns, "_d.*").withColumn("edit_size_band", M.edit_size_band(F.col("changed_tokens"), F.col("change_ratio")))


def method_summary(df: DataFrame, method: str = "method") -> DataFrame:
    """For each method: pairs, mean and median similarity and changed tokens."""
    return df.groupBy(method).agg(
        F.count("*").alias("pair_count"), F.round(F.avg("similarity"), 6).alias("mean_similarity"), F.round(F.median("similarity"), 6).alias("median_similarity"), F.round(F.avg("changed_tokens"), 4).alias("mean_changed_tokens"),
        F.min("changed_tokens").alias("least_changed_tokens"), F.max("changed_tokens").alias("most_changed_tokens"),
    )


def found_articles(pages: DataFrame, *columns: Column | str) -> DataFrame:
    """``columns`` of the detected articles, written once: a page is parsed once, and few come to Python at once, however many there are."""
    return staged(detected_articles(pages).select(*columns), "articles", rows_at_once=PAGES_AT_ONCE)


def scored_pages(pages: DataFrame, scorer: Callable[[Column], Column], page: str = "page_id") -> DataFrame:
    """Pages to articles to scores; what is no article has its reason instead."""
    columns = [page, "ok", "reason", "score", "paragraph_count", "character_count"]
    found = found_articles(pages, *columns, F.when(F.col("ok"), F.col("page.text")).alias("text"))
    answers = chunks.scored_requests(found.where("ok").select(page, "text"), page, "text", scorer)
    return found.select(*columns).join(answers, page, "left")
