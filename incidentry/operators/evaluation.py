"""Confusion matrix, class metrics, ROC and precision-recall curves of a scored table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentry.operators.joins import dense, fixed_table
from incidentry.operators.ordered import running_sums, share_buckets


def confusion_matrix(scored: DataFrame, classes: Sequence[int] = (0, 1)) -> DataFrame:
    """Count per label and prediction, zero cells included."""
    cells = scored.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("count"))
    grid = fixed_table(scored.sparkSession, [(a, b) for a in classes for b in classes], "label int, prediction int")
    return dense(grid, cells, ["label", "prediction"], ["count"])


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def class_metrics(scored: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where undefined."""
    cells = scored.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    none = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("actual"), none.alias("predicted"), hit.alias("hit")),
        F.struct(F.col("prediction").alias("class"), none.alias("actual"), F.col("n").alias("predicted"), none.alias("hit")),
    )
    classes = (
        cells.select(F.inline(sides))
        .groupBy("class")
        .agg(*[F.sum(name).alias(name) for name in ("actual", "predicted", "hit")])
    )
    precision, recall = _ratio(F.col("hit"), F.col("predicted")), _ratio(F.col("hit"), F.col("actual"))
    return classes.select(
        "class",
        precision.alias("precision"),
        recall.alias("recall"),
        _ratio(2 * precision * recall, precision + recall).alias("f1"),
        F.col("actual").alias("support"),
    )


def accuracy(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.avg(F.when(F.col("label") == F.col("prediction"), 1.0).otherwise(0.0)).alias("accuracy"),
        F.count(F.lit(1)).alias("rows"),
    )


def score_steps(scored: DataFrame) -> DataFrame:
    """Per distinct score from the highest: positives and negatives at the score, above it, and in all."""
    steps = scored.groupBy("probability").agg(
        F.sum(F.col("label").cast("bigint")).alias("positives"),
        F.sum(1 - F.col("label").cast("bigint")).alias("negatives"),
    )
    return running_sums(
        steps,
        order=[F.desc("probability")],
        buckets=[-level for level in share_buckets(F.col("probability"))],
        sums={"tp_before": F.col("positives"), "fp_before": F.col("negatives")},
        totals={"tp_before": "all_positives", "fp_before": "all_negatives"},
    )


def _curve(steps: DataFrame) -> DataFrame:
    tp, fp = F.col("tp_before") + F.col("positives"), F.col("fp_before") + F.col("negatives")
    return steps.select(
        F.col("probability").alias("threshold"),
        F.try_divide(fp.cast("double"), F.col("all_negatives")).alias("fpr"),
        F.try_divide(tp.cast("double"), F.col("all_positives")).alias("tpr"),
        F.try_divide(tp.cast("double"), tp + fp).alias("precision"),
    )


def roc_points(scored: DataFrame) -> DataFrame:
    return _curve(score_steps(scored)).select("threshold", "fpr", "tpr")


def precision_recall_points(scored: DataFrame) -> DataFrame:
    return _curve(score_steps(scored)).select("threshold", F.col("tpr").alias("recall"), "precision")


def curve_areas(scored: DataFrame) -> DataFrame:
    """Trapezoid areas under both curves; each step knows where it starts, so no neighbouring row is needed."""
    tp0, fp0 = F.col("tp_before").cast("double"), F.col("fp_before").cast("double")
    tp1, fp1 = tp0 + F.col("positives"), fp0 + F.col("negatives")
    started = F.when(tp0 + fp0 > 0, tp0 / F.nullif(tp0 + fp0, F.lit(0.0))).otherwise(1.0)
    roc = (fp1 - fp0) * (tp1 + tp0) / 2
    pr = (tp1 - tp0) * (tp1 / (tp1 + fp1) + started) / 2
    positives, negatives = F.first("all_positives"), F.first("all_negatives")
    return score_steps(scored).agg(
        F.try_divide(F.sum(roc), positives * negatives).alias("roc_auc"),
        F.try_divide(F.sum(pr), positives).alias("pr_auc"),
    )
