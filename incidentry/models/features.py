"""Feature frame for models, clusters and similarity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentry.operators.joins import top_values

BASE = {
    "hour": "hour",
    "is_weekend": "is_weekend",
    "is_kitchen": "is_kitchen",
    "is_bathroom": "is_bathroom",
    "participant_incident_count": "participant_prior_incidents",
    "carer_incident_count": "carer_prior_incidents",
    "location_risk_score": "location_risk_score",
    "severity_numeric": "severity_numeric",
}


@dataclass(frozen=True)
class Features:
    frame: DataFrame
    names: list[str]


def one_hot(df: DataFrame, column: str, prefix: str, k: int = 10) -> dict[str, Column]:
    """0/1 columns for the k most frequent values; k names come to the driver."""
    names = [row[0] for row in top_values(df, column, k).collect()]
    return {
        f"{prefix}__{name}".replace(".", "_"): F.when(F.col(column) == name, 1.0).otherwise(0.0) for name in names
    }


def feature_frame(df: DataFrame, keep: tuple[str, ...] = (), names_from: DataFrame | None = None) -> Features:
    """Prepared rows -> id, kept columns and features.

    ``names_from`` may be a cheaper table with the same rows (``derive`` instead of ``prepare``) to read the frequent values from.
    """
    source = df if names_from is None else names_from
    hot = one_hot(source, "location", "loc")
    if "incident_type" in df.columns:
        hot |= one_hot(source, "incident_type", "type")
    base = {name: F.coalesce(F.col(column).cast("double"), F.lit(0.0)) for name, column in BASE.items()}
    columns = base | hot
    frame = df.select("incident_id", *keep, *[value.alias(name) for name, value in columns.items()])
    return Features(frame, list(columns))
