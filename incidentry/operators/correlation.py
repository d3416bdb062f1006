"""Correlations of numeric columns and the leakage screen built on them."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentry.functions.common import clean_label, numeric_columns


def _corr(a: str, b: str) -> Column:
    value = F.corr(F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double"))
    return F.coalesce(F.nanvl(value, F.lit(None)), F.lit(0.0))


def _long(df: DataFrame, pairs: Sequence[tuple[str, str]], extra: Sequence[Column] = ()) -> DataFrame:
    """All pairs in one aggregation over the rows, then one output row per pair."""
    cells = [
        F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), _corr(a, b).alias("correlation")) for a, b in pairs
    ]
    return df.agg(F.array(*cells).alias("_cells"), *extra).select(F.explode("_cells").alias("_cell")).select("_cell.*")


def correlation_matrix(df: DataFrame, include: Sequence[str] | None = None) -> DataFrame:
    """Long form: feature_a, feature_b, correlation; pairs without a defined value get 0."""
    names = numeric_columns(df)
    if include:
        names = [name for name in include if name in names] or names
    upper = _long(df, list(combinations(names, 2)) + [(name, name) for name in names])
    lower = upper.where("feature_a <> feature_b").select(
        F.col("feature_b").alias("feature_a"), F.col("feature_a").alias("feature_b"), "correlation"
    )
    return upper.unionByName(lower)


def labelled(matrix: DataFrame) -> DataFrame:
    return matrix.withColumns({name: clean_label(name) for name in ("feature_a", "feature_b")})


def leakage_screen(df: DataFrame, target: str = "reportable_bin", threshold: float = 0.8) -> DataFrame:
    """Numeric columns whose correlation with the target is above the threshold, strongest first."""
    names = [name for name in numeric_columns(df) if name != target]
    found = _long(df, [(name, target) for name in names])
    return (
        found.select(F.col("feature_a").alias("feature"), F.abs("correlation").alias("correlation"))
        .where(F.col("correlation") > threshold)
        .orderBy(F.desc("correlation"), "feature")
    )


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    return df.groupBy(target).agg(F.count(F.lit(1)).alias("count"))
