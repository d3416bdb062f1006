"""Earlier and total incidents per participant and carer, and location risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentry import fixed_values as fixed
from incidentry.operators.joins import lookup_join
from incidentry.operators.ordered import running_sums, time_buckets


def with_counts(
    df: DataFrame,
    key: str,
    prior: str,
    total: str,
    time: str | Column = "incident_datetime",
    counted: DataFrame | None = None,
) -> DataFrame:
    """Number of earlier incidents of the same key in time order (unknown times last), and of all incidents.

    Rows are shuffled by key, time and a block of ids, never by the key alone, so a busy carer is spread over many tasks.
    """
    time = F.col(time) if isinstance(time, str) else time
    ordered = running_sums(
        df.withColumn("_time", time),
        order=[F.col("_time").asc_nulls_last(), F.col("incident_id")],
        buckets=time_buckets("_time", "incident_id"),
        sums={prior: F.lit(1).cast("bigint")},
        by=[key],
        totals={prior: total},
        counted=None if counted is None else counted.withColumn("_time", time),
    )
    return ordered.drop("_time")


def with_histories(df: DataFrame) -> DataFrame:
    rows = df
    for key, prefix in (("participant_id", "participant"), ("carer_id", "carer")):
        df = with_counts(df, key, f"{prefix}_prior_incidents", f"{prefix}_total_incidents", counted=rows)
    return df


def location_risk(df: DataFrame) -> DataFrame:
    """Mean severity per location, 1.0 where there is none."""
    return df.groupBy("location").agg(
        F.coalesce(F.avg("severity_numeric"), F.lit(1.0)).alias("location_risk_score")
    )


def with_location_risk(df: DataFrame, rated: DataFrame | None = None) -> DataFrame:
    """``rated`` may be the same rows before the histories were added: fewer columns and joins to read again."""
    return lookup_join(df, location_risk(df if rated is None else rated), "location", spread="incident_id")


def fallback_features(df: DataFrame) -> DataFrame:
    """The seven past-only features, for tables that did not pass the full preparation."""
    counted = df
    epoch = F.coalesce("incident_datetime", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    for key, prefix in (("participant_id", "participant"), ("carer_id", "carer")):
        counted = with_counts(counted, key, f"{prefix}_incident_count", f"_{prefix}_total", epoch, counted=df)
    place = F.lower(F.coalesce("location", F.lit("")))
    kitchen = F.when(place.contains(fixed.KITCHEN_PATTERN), 1.0).otherwise(0.0)
    bathroom = F.when(place.rlike(fixed.BATHROOM_PATTERN_FALLBACK), 1.0).otherwise(0.0)
    return counted.select(
        "incident_id",
        F.coalesce(F.hour("incident_datetime"), F.lit(0)).cast("double").alias("hour"),
        F.when(F.weekday("incident_datetime") >= 5, 1.0).otherwise(0.0).alias("is_weekend"),
        kitchen.alias("is_kitchen"),
        bathroom.alias("is_bathroom"),
        F.coalesce(F.col("participant_incident_count").cast("double"), F.lit(0.0)).alias("participant_incident_count"),
        F.coalesce(F.col("carer_incident_count").cast("double"), F.lit(0.0)).alias("carer_incident_count"),
        (3 * kitchen + 3 * bathroom + 1).alias("location_risk_score"),
    )
