"""Metrics of predictions: confusion, scores, ROC AUC, pair ranking, threshold sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLDS = tuple(round(t / 100, 2) for t in range(50, 100))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 if b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, truth: str, predicted: str, groups: list[str] | None = None) -> DataFrame:
    """true and false negatives and positives."""
    y, p = F.col(truth), F.col(predicted)
    return df.groupBy(*(groups or [])).agg(F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"), F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"))


def _f1(hit: Column, false_: Column, missed: Column) -> Column:
    return ratio(2 * hit, 2 * hit + false_ + missed)


def scores(counts: DataFrame, digits: int = 6) -> DataFrame:
    """accuracy, balanced accuracy, precision, recall and F1 of a confusion frame."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    f1, f0 = _f1(tp, fp, fn), _f1(tn, fn, fp)
    values = {
        "accuracy": ratio(tp + tn, n), "balanced_accuracy": (ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2, "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn),
        "real_recall": ratio(tn, tn + fp), "f1": f1, "macro_f1": (f1 + f0) / 2, "weighted_f1": ratio(f1 * (tp + fn) + f0 * (tn + fp), n),
    }
    return counts.withColumns({k: F.round(v, digits) for k, v in values.items()})


def classification_report(counts: DataFrame, digits: int = 4) -> DataFrame:
    """precision, recall, F1 and support of each class and their averages."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    real = (ratio(tn, tn + fn), ratio(tn, tn + fp), _f1(tn, fn, fp), tn + fp)
    fake = (ratio(tp, tp + fp), ratio(tp, tp + fn), _f1(tp, fp, fn), tp + fn)
    every = real[3] + fake[3]
    macro = (*((a + b) / 2 for a, b in zip(real[:3], fake[:3], strict=True)), every)
    weighted = (*(ratio(a * real[3] + b * fake[3], every) for a, b in zip(real[:3], fake[:3], strict=True)), every)
    lines = [F.struct(F.lit(name).alias("class"), *[F.round(v, digits).alias(c) for v, c in zip(x[:3], ("precision", "recall", "f1"), strict=True)], x[3].alias("support")) for name, x in (("real", real), ("fake", fake), ("macro avg", macro), ("weighted avg", weighted))]
    return counts.select(F.explode(F.array(*lines)).alias("x")).select("x.*")


def roc_auc(df: DataFrame, truth: str, score: str, steps: int = 4096) -> DataFrame:
    """The exact area under the ROC curve, ties counting half; null for one class.

    Distinct scores fall into ranges; negatives below a score are those in lower
    ranges, summed over the few ranges, and those lower in its own.
    """
    rows = df.where(F.col(truth).isNotNull() & F.col(score).isNotNull())
    per = rows.groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) == 0).alias("n"))
    ends = per.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))  # one row
    placed = per.join(F.broadcast(ends)).withColumn("r", F.coalesce(F.try_divide((F.col("s") - F.col("lo")) * steps, F.col("hi") - F.col("lo")), F.lit(0.0)).cast("int")).drop("lo", "hi")
    ranges = placed.groupBy("r").agg(F.sum("n").alias("rn"))
    below = ranges.select("r", (F.sum("rn").over(Window.orderBy("r")) - F.col("rn")).alias("before"))  # a row for each range
    inside = F.sum("n").over(Window.partitionBy("r").orderBy("s")) - F.col("n")
    won = placed.withColumn("inside", inside).join(F.broadcast(below), "r")
    total = won.agg(F.sum(F.col("p") * (F.col("before") + F.col("inside") + F.col("n") / 2.0)).alias("won"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return total.select(F.try_divide(F.col("won"), F.col("p") * F.col("n").cast("double")).alias("roc_auc"))


def pair_ranking(df: DataFrame, pair: str = "pair_id", truth: str = "true_label", score: str = "fake_probability") -> DataFrame:
    """Of pairs with one real and one fake text, the share whose fake scores higher; ties are wrong."""
    y, s = F.col(truth), F.col(score)
    pairs = df.groupBy(pair).agg(F.count_if(y == 1).alias("fakes"), F.count_if(y == 0).alias("reals"), F.max(F.when(y == 1, s)).alias("fake"), F.max(F.when(y == 0, s)).alias("real")).where("fakes = 1 and reals = 1")
    return pairs.agg(F.count("*").alias("pair_count"), F.count_if(F.col("fake") > F.col("real")).alias("correct_pairs"), F.avg(F.when(F.col("fake") > F.col("real"), 1.0).otherwise(0.0)).alias("pair_ranking_accuracy"))


def threshold_table(df: DataFrame, truth: str = "true_label", predicted: str = "predicted_label", confidence: str = "confidence", thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """What answering only above a confidence gains and costs, for each threshold.

    Predictions are first counted by (threshold step, truth, prediction), at most a
    few hundred rows; the sweep itself runs over those.
    """
    points = sorted(thresholds)
    step = sum((F.when(F.col(confidence) >= t, 1).otherwise(0) for t in points), F.lit(0))  # thresholds that this row reaches
    cells = df.groupBy(step.alias("step"), F.col(truth).alias("y"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    table = df.sparkSession.createDataFrame([(t, i + 1) for i, t in enumerate(points)], "threshold double, needs int")
    cross = cells.join(F.broadcast(table))
    kept, wrong = F.col("step") >= F.col("needs"), F.col("y") != F.col("p")

    def count(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("n")).otherwise(0))

    t = cross.groupBy("threshold").agg(
        F.sum("n").alias("total"), count(kept).alias("accepted_count"), count(kept & ~wrong).alias("right"), count(wrong).alias("total_model_errors"), count(wrong & ~kept).alias("errors_caught"),
        count(~kept & ~wrong).alias("correct_marked_uncertain"), *[count(kept & (F.col("y") == a) & (F.col("p") == b)).alias(f"k{a}{b}") for a in (0, 1) for b in (0, 1)],
    )
    c = F.col
    uncertain = c("total") - c("accepted_count")
    precision, recall = ratio(c("errors_caught"), uncertain), ratio(c("errors_caught"), c("total_model_errors"))
    macro = (_f1(c("k11"), c("k01"), c("k10")) + _f1(c("k00"), c("k10"), c("k01"))) / 2
    return t.select(
        "threshold", "accepted_count", uncertain.alias("uncertain_count"), F.round(ratio(c("accepted_count"), c("total")), 6).alias("coverage"), F.round(ratio(uncertain, c("total")), 6).alias("uncertainty_rate"),
        F.round(ratio(c("right"), c("accepted_count")), 6).alias("selective_accuracy"), F.round(macro, 6).alias("selective_macro_f1"), "total_model_errors", "errors_caught",
        (c("total_model_errors") - c("errors_caught")).alias("errors_missed"), "correct_marked_uncertain", F.round(precision, 6).alias("uncertainty_precision"), F.round(recall, 6).alias("error_catch_rate"),
        F.round(ratio(2 * precision * recall, precision + recall), 6).alias("error_detection_f1"),
    )


def recommendations(table: DataFrame, accuracies: tuple[float, ...] = (0.97, 0.98)) -> DataFrame:
    """The threshold that detects errors best, and those of greatest coverage that reach each accuracy."""
    best = table.orderBy(F.col("error_detection_f1").desc(), F.col("coverage").desc(), "threshold").limit(1).withColumn("recommendation", F.lit("best_error_detection"))
    for a in accuracies:
        pick = table.where(F.col("selective_accuracy") >= a).orderBy(F.col("coverage").desc(), "threshold").limit(1)
        best = best.unionByName(pick.withColumn("recommendation", F.lit(f"max_coverage_accuracy_{a:.2f}")))
    return best.select("recommendation", "threshold", "coverage", "selective_accuracy", "error_detection_f1")
