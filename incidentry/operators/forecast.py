"""Monthly volume forecasts for one series or for many at once.

A series is one array of monthly counts per group. Its length is the number of months, whatever the number of incidents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentry.functions.clock import month_start

Z95 = 1.96


def monthly_series(df: DataFrame, groups: Sequence[str] = (), date: str = "incident_date") -> DataFrame:
    """One row per group: first month, last month and the gap-free counts between them."""
    counts = (
        df.where(F.col(date).isNotNull())
        .groupBy(*groups, month_start(date).alias("month"))
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    )
    packed = counts.groupBy(*groups).agg(
        F.map_from_entries(F.collect_list(F.struct("month", "n"))).alias("_counts"),
        F.min("month").alias("first_month"),
        F.max("month").alias("last_month"),
    )
    months = F.sequence("first_month", "last_month", F.expr("interval 1 month"))
    filled = F.transform(months, lambda m: F.coalesce(F.try_element_at("_counts", m), F.lit(0.0)))
    return packed.where("first_month is not null").withColumn("y", filled).drop("_counts")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def _last(values: Column, back: int) -> Column:
    return F.try_element_at(values, F.lit(-back))


def _clamp(value: Column, reach: Column) -> Column:
    return F.greatest(-reach, F.least(reach, value))


def _shape(series: DataFrame, season: int) -> DataFrame:
    """Length, mean, sample deviation, trends of a series."""
    y, n = F.col("_v"), F.col("_n")
    recent = _sum(F.slice(y, F.greatest(n - season + 1, F.lit(1)), F.lit(season))) / season
    older = _sum(F.slice(y, F.greatest(n - 2 * season + 1, F.lit(1)), F.lit(season))) / season
    change = F.when(older == 0, 0.1).otherwise(_clamp((recent - older) / F.nullif(older, F.lit(0.0)), F.lit(0.1)))
    slope = (_last(y, 1) - _last(y, 3)) / 2
    with_mean = series.withColumn("_n", F.size("_v")).withColumn("_mean", _sum(y) / n)
    spread = F.aggregate(y, F.lit(0.0), lambda total, v: total + (v - F.col("_mean")) * (v - F.col("_mean")))
    return with_mean.withColumns(
        {
            "_std": F.when(n > 1, F.sqrt(spread / F.nullif(n - 1, F.lit(0)))),
            "_change": F.when(n >= 2 * season, change).otherwise(0.0),
            "_slope": F.when(n >= 3, _clamp(slope, _last(y, 1) * 0.1)),
            "_last": _last(y, 1),
        }
    )


def forecast(
    df: DataFrame,
    horizon: int = 6,
    groups: Sequence[str] = (),
    date: str = "incident_date",
    season: int = 12,
    log_space: bool = False,
    flat: bool = False,
) -> DataFrame:
    """Actual months followed by ``horizon`` forecast months with a 95 % band.

    Fewer than three months: their mean. A season or more: the last season, shifted by the change of the yearly means
    (10 % at most). Otherwise a damped straight line. ``flat`` repeats the last month instead. ``log_space`` works on
    log(1 + y) and caps the result at three (band: four) times the largest month.
    """
    series = monthly_series(df, groups, date)
    value = F.transform("y", lambda v: F.log1p(F.greatest(v, F.lit(0.1)))) if log_space else F.col("y")
    shaped = _shape(series.withColumn("_v", value), season)

    def ahead(i: Column) -> Column:
        step = i.cast("double")
        seasonal = F.try_element_at("_v", (F.col("_n") - season + 1 + F.pmod(i - 1, F.lit(season))).cast("int"))
        few = F.col("_n") < 3
        if flat:
            point = F.greatest(F.lit(0.1), F.col("_last"))
        else:
            point = (
                F.when(few, F.col("_mean"))
                .when(F.col("_n") >= season, seasonal * (1 + F.col("_change")))
                .otherwise(F.greatest(F.lit(0.1), F.col("_last") + F.col("_slope") * step))
            )
        level = F.lit(True) if flat else few
        base = F.greatest(F.lit(0.1), F.col("_last")) if flat else F.col("_mean")
        known = F.col("_std").isNotNull()
        reach = F.when(level, F.when(known, F.greatest(F.col("_std"), F.sqrt(base)))).otherwise(F.col("_std") * F.sqrt(step))
        low, high = point - Z95 * reach, point + Z95 * reach
        if log_space:
            most = F.array_max("y")
            point = F.least(F.expm1(point), most * 3)
            low, high = F.expm1(low), F.least(F.expm1(high), most * 4)
        return F.struct(
            F.add_months("last_month", i).alias("date"),
            F.lit(None).cast("double").alias("actual"),
            point.alias("forecast"),
            F.when(low.isNotNull(), F.greatest(F.lit(0.0), low)).alias("lower"),
            high.alias("upper"),
        )

    none = F.lit(None).cast("double")
    past = F.transform(
        "y",
        lambda v, i: F.struct(
            F.add_months("first_month", i).alias("date"),
            v.alias("actual"),
            none.alias("forecast"),
            none.alias("lower"),
            none.alias("upper"),
        ),
    )
    future = F.transform(F.sequence(F.lit(1), F.lit(horizon)), ahead)
    return shaped.select(*groups, F.inline(F.concat(past, future)))
