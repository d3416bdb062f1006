"""Risk scores for described situations, and the alerts they raise."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentry import fixed_values as fixed
from incidentry.functions.grades import risk_level
from incidentry.functions.wording import recommendation
from incidentry.models.classifiers import TrainedModel
from incidentry.operators.joins import fixed_table

SCENARIO_SCHEMA = (
    "scenario string, hours array<int>, location_contains string, day_type string, participant_history string, "
    "carer_history string, severity string"
)


def preset_scenarios(spark: SparkSession) -> DataFrame:
    return fixed_table(spark, fixed.SCENARIOS, SCENARIO_SCHEMA)


def _threshold(column: str, default: int):
    """First whole number in a text such as '>= 3'."""
    found = F.regexp_extract(F.col(column).cast("string"), r"(\d+)", 1)
    return F.coalesce(F.when(found != "", found).try_cast("int"), F.lit(default))


def filled_scenarios(scenarios: DataFrame) -> DataFrame:
    """Conditions turned into one situation each: middle hour, least history, location risk 3, 2 or 1."""
    place = F.lower(F.coalesce("location_contains", F.lit("")))
    ordered = F.array_sort("hours")
    size = F.size("hours")
    low = F.try_element_at(ordered, F.floor((size + 1) / 2).cast("int"))
    high = F.try_element_at(ordered, F.floor(size / 2).cast("int") + 1)
    room = place.rlike("kitchen|" + fixed.BATHROOM_PATTERN_FALLBACK)
    return scenarios.select(
        "scenario",
        "severity",
        F.when(size > 0, F.floor((low + high) / 2)).otherwise(8).cast("int").alias("hour"),
        F.coalesce("location_contains", F.lit("")).alias("location"),
        F.coalesce("day_type", F.lit("weekday")).alias("day_type"),
        _threshold("participant_history", 3).alias("participant_history"),
        _threshold("carer_history", 5).alias("carer_history"),
        F.when(room, 3).when(place.contains("transport"), 2).otherwise(1).alias("location_risk"),
    )


def scenario_features(scenarios: DataFrame, names: list[str]) -> DataFrame:
    """The seven features a situation describes, under the names the model expects; all others are 0."""
    place = F.lower(F.coalesce("location", F.lit("")))
    known = {
        "hour": F.coalesce("hour", F.lit(12)),
        "is_weekend": F.when(F.col("day_type") == "weekend", 1).otherwise(0),
        "is_kitchen": F.when(place.contains(fixed.KITCHEN_PATTERN), 1).otherwise(0),
        "is_bathroom": F.when(place.rlike(fixed.BATHROOM_PATTERN), 1).otherwise(0),
        "participant_incident_count": F.coalesce("participant_history", F.lit(1)),
        "carer_incident_count": F.coalesce("carer_history", F.lit(1)),
        "location_risk_score": F.coalesce("location_risk", F.lit(2)),
    }
    described = scenarios.select(F.struct("*").alias("_situation"), *[v.cast("double").alias(f"_{n}") for n, v in known.items()])
    return described.select(
        "_situation", *[(F.col(f"_{name}") if name in known else F.lit(0.0)).alias(name) for name in names]
    )


def risk_scores(scenarios: DataFrame, trained: TrainedModel) -> DataFrame:
    """Score and level of any number of situations by a trained model."""
    chance = vector_to_array("probability")
    rows = trained.model.transform(scenario_features(scenarios, trained.feature_names))
    return (
        rows.withColumn("risk_score", F.when(F.size(chance) > 1, chance[1]).otherwise(F.array_max(chance)))
        .select("_situation.*", "risk_score")
        .withColumns({"risk_level": risk_level("risk_score"), "model_used": F.lit(trained.name)})
    )


def scenario_alerts(scores: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Situations whose score is above the limit for their severity, with recommendations."""
    limits = fixed.ALERT_THRESHOLDS if thresholds is None else thresholds
    limit = F.coalesce(
        *[F.when(F.lower("severity") == name, value) for name, value in limits.items()], F.lit(fixed.DEFAULT_ALERT_THRESHOLD)
    )
    return (
        scores.withColumn("threshold", limit)
        .where(F.col("risk_score") > F.col("threshold"))
        .withColumn("recommendation", recommendation("scenario"))
    )
