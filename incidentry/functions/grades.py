"""Severity, yes/no flags and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incidentry import fixed_values as fixed
from incidentry.functions.common import as_column, banded, beside, pick, strip


def normal_severity(value: str | Column) -> Column:
    return pick(F.lower(strip(as_column(value))), fixed.SEVERITY_WORDS, "Medium")


def severity_rank(value: str | Column, unknown: int | None = None) -> Column:
    return pick(as_column(value), fixed.SEVERITY_RANK, unknown)


def map_severity(value: str | Column) -> Column:
    """Severity as the map names it: known names stay, otherwise the first letters decide."""
    value = as_column(value)
    low = F.lower(value)
    return (
        F.when(value.isin(list(fixed.MAP_SEVERITY_RANK)), value)
        .when(low.startswith("crit"), "Critical")
        .when(low.startswith("high"), "High")
        .when(low.startswith("mod"), "Moderate")
        .when(low.startswith("med"), "Medium")
        .otherwise("Low")
    )


def map_severity_rank(value: str | Column) -> Column:
    return pick(as_column(value), fixed.MAP_SEVERITY_RANK)


def plain_flag(value: str | Column) -> Column:
    """Text variant: only 'yes', 'true' and '1' count."""
    return F.when(F.lower(as_column(value).cast("string")).isin(fixed.PLAIN_TRUE_WORDS), 1).otherwise(0)


def _word_flag(value: Column) -> Column:
    return F.when(F.lower(strip(value)).isin(fixed.TRUE_WORDS), 1).otherwise(0)


def _number_flag(value: Column) -> Column:
    return F.when(value.try_cast("double") > 0, 1).otherwise(0)


def with_flag(df: DataFrame, source: str, target: str, numeric: bool | None = None) -> DataFrame:
    """Add ``target`` as 0/1.

    Booleans and numbers need no look at the data. Text is read as numbers as soon as one value of the column is a number,
    else as words; pass ``numeric`` to skip that one-row probe.
    """
    kind = df.schema[source].dataType
    value = F.col(source)
    if isinstance(kind, T.BooleanType):
        return df.withColumn(target, F.when(value, 1).otherwise(0))
    if isinstance(kind, T.NumericType):
        return df.withColumn(target, F.when(value > 0, 1).otherwise(0))
    if isinstance(kind, T.NullType):
        return df.withColumn(target, F.lit(0))
    if numeric is not None:
        return df.withColumn(target, _number_flag(value) if numeric else _word_flag(value))
    probe = df.agg(F.coalesce(F.bool_or(value.try_cast("double").isNotNull()), F.lit(False)).alias("_numeric"))
    return beside(df, probe).withColumn(
        target, F.when(F.col("_numeric"), _number_flag(value)).otherwise(_word_flag(value))
    ).drop("_numeric")


def at_least(value: Column, bound: float) -> Column:
    return value >= bound


def at_most(value: Column, bound: float) -> Column:
    return value <= bound


def above(value: Column, bound: float) -> Column:
    return value > bound


def workload_band(per_month: str | Column) -> Column:
    return banded(as_column(per_month), fixed.WORKLOAD_BANDS, at_least)


def compliance_band(rate: str | Column) -> Column:
    return banded(as_column(rate), fixed.COMPLIANCE_BANDS, at_least)


def delay_band(days: str | Column) -> Column:
    return banded(as_column(days), fixed.DELAY_BANDS, at_most)


def risk_level(score: str | Column) -> Column:
    return banded(as_column(score), fixed.RISK_BANDS, above)
