"""Two baseline classifiers behind the leakage guard, their scores and what they look at."""

from __future__ import annotations

import statistics
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentry.functions.common import clean_label
from incidentry.models.features import feature_frame
from incidentry.models.guard import LeakageGuard
from incidentry.models.splits import group_split, stratified_split, time_split, with_folds
from incidentry.session import settle

SUSPICIOUS_ACCURACY, WEAK_CV_ACCURACY = 0.98, 0.9


@dataclass
class TrainedModel:
    name: str
    model: PipelineModel
    accuracy: float
    cv_accuracy: float | None
    cv_deviation: float | None
    feature_names: list[str]
    predictions: DataFrame

    @property
    def suspicious(self) -> bool:
        """So accurate that leakage is likely."""
        return self.accuracy >= SUSPICIOUS_ACCURACY

    @property
    def overfitted(self) -> bool:
        """As accurate as that on its test rows, but not over the folds."""
        return self.suspicious and self.cv_accuracy is not None and self.cv_accuracy < WEAK_CV_ACCURACY

    @property
    def guard_report(self) -> DataFrame:
        return self.model.stages[0].report(self.predictions.sparkSession)


def with_label(df: DataFrame, target: str | None = None) -> DataFrame:
    """``label``: the given column, else whether severity is high or critical."""
    if target is not None and target in df.columns:
        return df.withColumn("label", F.col(target).cast("int"))
    return df.withColumn("label", F.when(F.col("severity_numeric") >= 3, 1).otherwise(0))


def split(df: DataFrame, strategy: str = "time", time: str = "incident_datetime", group: str | None = None,
          test_size: float = 0.25, seed: int = 42) -> DataFrame:
    if strategy == "time":
        return time_split(df, time)
    if strategy == "group" and group is not None:
        return group_split(df, group, test_size, seed)
    return stratified_split(df, "label", test_size, seed)


def balanced_weights(train: DataFrame) -> tuple[DataFrame, float]:
    """``weight`` per class so that classes count alike, and the sum of all weights."""
    counts = {row["label"]: row["n"] for row in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = sum(counts.values())
    weights = {label: rows / (len(counts) * n) for label, n in counts.items()}
    chain = reduce(lambda c, item: c.when(F.col("label") == item[0], item[1]), weights.items(), F.when(F.lit(False), 1.0))
    return train.withColumn("weight", chain), float(rows)


def random_forest(seed: int) -> list:
    return [
        RandomForestClassifier(
            numTrees=50, maxDepth=4, minInstancesPerNode=5, weightCol="weight", labelCol="label", featuresCol="features", seed=seed
        )
    ]


def logistic_regression(rows: float, strength: float = 0.1) -> list:
    """Features are scaled by their population deviation.

    The scaler uses the sample deviation, so scaled values are smaller by the root of (rows - 1) / rows; the same share of the penalty gives
    the same model. The weights of balanced classes sum to the number of rows.
    """
    return [
        StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
        LogisticRegression(
            regParam=max(1.0, rows - 1) / (strength * rows * rows), standardization=False, maxIter=1000,
            weightCol="weight", labelCol="label", featuresCol="scaled",
        ),
    ]


def scored(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """incident_id, label, prediction and probability of class 1."""
    chance = vector_to_array("probability")
    return model.transform(rows).select(
        "incident_id",
        "label",
        F.col("prediction").cast("int").alias("prediction"),
        F.when(F.size(chance) > 1, chance[1]).otherwise(F.array_max(chance)).alias("probability"),
    )


def cross_validated(
    guard: LeakageGuard, tails: dict[str, Callable[[float], list]], train: DataFrame, rows: int, seed: int
) -> dict[str, tuple[float | None, float | None]]:
    """Mean and deviation of the accuracy of every model over up to three stratified folds; none for ten rows or fewer.

    All models share the folds. The guard is fitted anew on the rows of each, once for all models, and class weights are those of the rows a
    fold is fitted on; a tail builds the estimators behind the guard for their number.
    """
    folds = min(3, rows // 10)
    if rows <= 10 or folds < 2:
        return dict.fromkeys(tails, (None, None))
    numbered = settle(with_folds(train.drop("weight"), folds, seed=seed))
    scores = {name: [] for name in tails}
    for fold in range(folds):
        weighted, count = balanced_weights(numbered.where(F.col("fold") != fold))
        guarded, left_out = guard.fit(weighted), numbered.where(F.col("fold") == fold)
        for name, tail in tails.items():
            model = Pipeline(stages=[guarded, *tail(count)]).fit(weighted)
            scores[name].append(accuracy(scored(model, left_out)))
    return {name: (statistics.fmean(found), statistics.pstdev(found)) for name, found in scores.items()}


def accuracy(predictions: DataFrame) -> float:
    right = F.avg(F.when(F.col("label") == F.col("prediction"), 1.0).otherwise(0.0))
    return predictions.agg(right).first()[0] or 0.0


def compare_models(
    prepared: DataFrame,
    target: str | None = None,
    strategy: str = "time",
    time: str = "incident_datetime",
    group: str | None = None,
    test_size: float = 0.25,
    seed: int = 42,
    corr_threshold: float = 0.80,
    cross_validate: bool = True,
    names_from: DataFrame | None = None,
) -> dict[str, TrainedModel]:
    """Train both classifiers on the same split. The feature table is stored once, before anything looks for a split in it."""
    labelled = with_label(prepared, target)
    keep = tuple(dict.fromkeys(name for name in ("label", time, group) if name))
    features = feature_frame(labelled, keep, names_from)
    table = split(settle(features.frame), strategy, time, group, test_size, seed)
    if strategy != "time":  # there ``is_test`` is a comparison of stored columns
        table = settle(table)
    train, test = table.where("not is_test"), table.where("is_test")
    weighted, weight_sum = balanced_weights(train)
    guard = LeakageGuard(features.names, corr_threshold=corr_threshold)
    guarded = guard.fit(weighted)
    tails = {"RandomForest": lambda rows: random_forest(seed), "LogisticRegression": logistic_regression}
    # here the guard is fitted anew in every fold
    folds = cross_validated(guard, tails, weighted, int(weight_sum), seed) if cross_validate else dict.fromkeys(tails, (None, None))
    results = {}
    for name, tail in tails.items():
        model = Pipeline(stages=[guarded, *tail(weight_sum)]).fit(weighted)
        predictions = scored(model, test)
        results[name] = TrainedModel(name, model, accuracy(predictions), *folds[name], guarded.kept, predictions)
    return results


def best_model(models: dict[str, TrainedModel]) -> TrainedModel:
    return max(models.values(), key=lambda trained: trained.accuracy)


def model_table(models: dict[str, TrainedModel], spark) -> DataFrame:
    rows = [
        (m.name, float(m.accuracy), m.cv_accuracy, m.cv_deviation, len(m.feature_names), m.suspicious, m.overfitted) for m in models.values()
    ]
    return spark.createDataFrame(
        rows, "model string, accuracy double, cv_accuracy double, cv_deviation double, features int, suspicious boolean, overfitted boolean"
    )


def feature_ranking(trained: TrainedModel, spark, k: int = 20) -> DataFrame:
    """The k features with the largest importance, or the largest coefficient by size."""
    last = trained.model.stages[-1]
    values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    rows = [(name, float(value)) for name, value in zip(trained.feature_names, values.toArray())]
    ranked = spark.createDataFrame(rows, "feature string, importance double").withColumn("importance", F.abs("importance"))
    return ranked.orderBy(F.desc("importance"), "feature").limit(k).withColumn("feature", clean_label("feature"))
