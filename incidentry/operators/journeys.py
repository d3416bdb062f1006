"""What happened to one participant, or to all of them, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentry.operators.history import with_counts

TIMELINE = ["incident_id", "incident_date", "severity", "severity_numeric", "location"]


def journey(df: DataFrame, participant_id: str) -> DataFrame:
    return df.where(F.col("participant_id") == participant_id).select(*TIMELINE).orderBy("incident_date", "incident_id")


def journeys(df: DataFrame) -> DataFrame:
    """Timeline of every participant with the step number of each incident."""
    stepped = with_counts(df.where("participant_id is not null"), "participant_id", "_before", "steps", "incident_date")
    return stepped.select("participant_id", (F.col("_before") + 1).alias("step"), "steps", *TIMELINE)


def journey_locations(df: DataFrame) -> DataFrame:
    """How often each location occurs in each participant's journey."""
    return (
        df.where("participant_id is not null and location is not null")
        .groupBy("participant_id", "location")
        .agg(F.count(F.lit(1)).alias("count"))
    )
