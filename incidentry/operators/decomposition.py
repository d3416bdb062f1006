"""Trend, season and rest of monthly series, and tests of what a series or a forecast leaves over.

A series is one array of gap-free months per group, as long as the number of months, so all of this works inside a row. ``additive`` is the
classical decomposition by centred moving averages. ``robust`` alternates local straight lines over each calendar month and over the months,
and weights months by how far they lie from both, so that single outliers move neither.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentry.operators.forecast import monthly_series

SEASON = 12
ROUNDS, PASSES = 3, 3
TREND_SPAN, SEASON_SPAN = 19, 7


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b) / F.nullif(F.size(values), F.lit(0))


def additive(df: DataFrame, groups: Sequence[str] = (), date: str = "incident_date", season: int = SEASON) -> DataFrame:
    """(groups, month, actual, trend, season, rest) for every month of every group.

    The trend is the mean over a season around the month, with half a month at both ends where the season is even; it is null in the first
    and last half season. The season is the mean, for each month of the season, of actual less trend, moved so that a whole season sums to
    zero; the rest is what remains, null where the trend is. Series shorter than two seasons have neither.
    """
    half, even = season // 2, season % 2 == 0
    weight = {k: 0.5 if even and abs(k) == half else 1.0 for k in range(-half, half + 1)}
    rows = monthly_series(df, groups, date).withColumn("_n", F.size("y"))

    def around(i: Column) -> Column:
        whole = (i >= half) & (i < F.col("_n") - half) & (F.col("_n") >= 2 * season)
        return F.when(whole, sum((F.get("y", i + k) * w for k, w in weight.items()), F.lit(0.0)) / season)

    rows = rows.withColumn("_trend", F.transform(F.sequence(F.lit(0), F.col("_n") - 1), around))
    rows = rows.withColumn("_left", F.zip_with("y", "_trend", lambda y, trend: y - trend))
    rows = rows.withColumn("_raw", F.array(*[_mean(_every("_left", season, place)) for place in range(season)]))
    rows = rows.withColumn("_base", _mean(F.col("_raw"))).withColumn("_shares", F.transform("_raw", lambda share: share - F.col("_base")))
    months = F.sequence("first_month", "last_month", F.expr("interval 1 month"))
    seasonal = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.get("_shares", i % season))
    zipped = F.arrays_zip(months.alias("month"), F.col("y").alias("actual"), F.col("_trend").alias("trend"), seasonal.alias("season"))
    return rows.select(*groups, F.inline(zipped)).withColumn("rest", F.col("actual") - F.col("trend") - F.col("season"))


def _every(values: str, season: int, place: int) -> Column:
    """The values that are not null, of one month of the season."""
    return F.filter(values, lambda v, i: v.isNotNull() & (i % season == place))


def local_line(values: np.ndarray, weights: np.ndarray, span: int) -> np.ndarray:
    """At each place, the value there of a straight line through the ``span`` nearest places, weighted by nearness (tricube) and ``weights``."""
    n = len(values)
    at = np.arange(n, dtype=float)
    away = np.abs(at[:, None] - at)
    reach = np.sort(away, axis=1)[:, min(span, n) - 1] * max(1.0, span / n) + 1e-9
    near = np.clip(1 - (away / (reach[:, None] + 0.5)) ** 3, 0, None) ** 3 * weights
    total = near.sum(axis=1)
    near[total <= 0] = 1.0  # all weights nearby are gone
    total = near.sum(axis=1)
    centre = near @ at / total
    mean = near @ values / total
    spread = (near * (at - centre[:, None]) ** 2).sum(axis=1)
    slope = (near * (at - centre[:, None])) @ values / np.where(spread > 1e-12, spread, np.inf)
    return mean + slope * (at - centre)


def robust_parts(y: np.ndarray, season: int = SEASON) -> tuple[np.ndarray, np.ndarray]:
    """(trend, season) of one series; series shorter than two seasons have the season zero."""
    n = len(y)
    weights, trend, seasonal = np.ones(n), np.zeros(n), np.zeros(n)
    if n < 2 * season:
        return local_line(y, weights, TREND_SPAN) if n else trend, seasonal
    for _ in range(ROUNDS):
        for _ in range(PASSES):
            left = y - trend
            for place in range(season):
                seasonal[place::season] = local_line(left[place::season], weights[place::season], SEASON_SPAN)
            level = np.convolve(np.pad(seasonal, season // 2, mode="wrap"), np.ones(season) / season, "same")[season // 2 : season // 2 + n]
            seasonal = seasonal - level  # what all months share belongs to the trend
            trend = local_line(y - seasonal, weights, TREND_SPAN)
        off = np.abs(y - trend - seasonal)
        scale = 6 * np.median(off)
        weights = np.clip(1 - (off / scale) ** 2, 0, None) ** 2 if scale > 1e-9 else np.ones(n)
    return trend, seasonal


def _by_series(column: pa.ListArray) -> list[np.ndarray]:
    return [np.array(values or [], float) for values in column.to_pylist()]


def robust(df: DataFrame, groups: Sequence[str] = (), date: str = "incident_date", season: int = SEASON) -> DataFrame:
    """(groups, month, actual, trend, season, rest) by local lines; trend, season and rest of every month sum to its actual."""

    @F.arrow_udf("struct<trend:array<double>, season:array<double>>")
    def parts(column: pa.Array) -> pa.Array:
        found = [robust_parts(y, season) for y in _by_series(column)]
        return pa.StructArray.from_arrays([pa.array([f[i] for f in found], pa.list_(pa.float64())) for i in range(2)], ["trend", "season"])

    rows = monthly_series(df, groups, date).withColumn("_parts", parts("y"))
    months = F.sequence("first_month", "last_month", F.expr("interval 1 month"))
    zipped = F.arrays_zip(months.alias("month"), F.col("y").alias("actual"), F.col("_parts.trend").alias("trend"), F.col("_parts.season").alias("season"))
    rows = rows.select(*groups, F.inline(zipped))
    return rows.withColumn("rest", F.col("actual") - F.col("trend") - F.col("season"))


def _product(n: Column, k: int) -> Column:
    """The sum of products of values k places apart."""
    return F.aggregate(F.sequence(F.lit(0), n - 1 - k), F.lit(0.0), lambda total, i: total + F.get("_off", i) * F.get("_off", i + k))


def portmanteau(series: DataFrame, values: str = "y", lags: int = SEASON) -> DataFrame:
    """``series`` with n, ``q`` and ``autocorrelations``: n (n + 2) times the sum over lags k of r_k^2 / (n - k), Ljung and Box's statistic.

    r_k are autocorrelations about the mean. Series with as many values as lags or fewer, and constant ones, have null.
    """
    n = F.size(values)
    rows = series.withColumn("_mean", _mean(F.col(values))).withColumn("_off", F.transform(values, lambda v: v - F.col("_mean")))
    rows = rows.withColumn("_square", F.aggregate("_off", F.lit(0.0), lambda total, v: total + v * v))
    fine = (n > lags) & (F.col("_square") > 1e-12)
    rows = rows.withColumn("autocorrelations", F.when(fine, F.array(*[_product(n, k) / F.nullif("_square", F.lit(0.0)) for k in range(1, lags + 1)])))
    each = F.transform("autocorrelations", lambda r, i: r * r / (n - 1 - i))
    q = n * (n + 2) * F.aggregate(each, F.lit(0.0), lambda a, b: a + b)
    return rows.withColumns({"n": n, "q": F.when(fine, q)}).drop("_mean", "_off", "_square")


def unit_root(y: np.ndarray, most: int | None = None) -> tuple[float, int]:
    """Dickey and Fuller's t with a constant, and the number of lagged differences, chosen by Akaike's criterion; NaN where it is not defined."""
    n = len(y)
    if most is None:
        most = min(int(12 * (n / 100) ** 0.25), n // 2 - 3)
    if n < 8 or most < 0 or np.ptp(y) < 1e-12:
        return math.nan, 0
    steps = np.diff(y)

    def fitted(lags: int, first: int) -> tuple[float, float]:
        """t of the level and the criterion, over differences from ``first`` on."""
        x = np.column_stack([y[first:-1], np.ones(len(steps) - first), *[steps[first - k : len(steps) - k] for k in range(1, lags + 1)]])
        target = steps[first:]
        beta, _, rank, _ = np.linalg.lstsq(x, target, rcond=None)
        off = target - x @ beta
        m, p = x.shape
        left = float(off @ off)
        if rank < p or m <= p or left < 1e-12 * max(1.0, float(target @ target)):
            return math.nan, math.inf
        error = math.sqrt(left / (m - p) * np.linalg.inv(x.T @ x)[0, 0])
        return float(beta[0] / error), m * math.log(left / m) + 2 * p

    best = min(range(most + 1), key=lambda lags: (fitted(lags, most)[1], lags))
    return fitted(best, best)[0], best


def stationarity(series: DataFrame, values: str = "y") -> DataFrame:
    """``series`` with ``unit_root`` (t, far below -2.86 where a series keeps to its mean) and ``lags``."""

    @F.arrow_udf("struct<t:double, lags:int>")
    def tested(column: pa.Array) -> pa.Array:
        found = [unit_root(y) for y in _by_series(column)]
        t = pa.array([None if math.isnan(a) else a for a, _ in found], pa.float64())
        return pa.StructArray.from_arrays([t, pa.array([b for _, b in found], pa.int32())], ["t", "lags"])

    rows = series.withColumn("_test", tested(F.col(values)))
    return rows.withColumns({"unit_root": F.col("_test.t"), "lags": F.col("_test.lags")}).drop("_test")


def rests(parts: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, y): what a decomposition leaves over, by month, as one array per group."""
    known = parts.where("rest is not null").groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("month", "rest"))).alias("_e"))
    return known.select(*groups, F.col("_e.rest").alias("y"))
