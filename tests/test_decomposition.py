"""Decomposition and tests of series against plain numpy versions."""

import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from incidentry.operators import decomposition

MONTHS = [date(2015 + i // 12, i % 12 + 1, 3) for i in range(72)]


def series_of(spark, counts):
    """A row per incident: (name, date)."""
    rows = [(name, MONTHS[i]) for name, values in counts.items() for i, n in enumerate(values) for _ in range(n)]
    return spark.createDataFrame(rows, "name string, incident_date date").repartition(4)


def wave(n, slope=0.3, outlier=None):
    season = [0, 4, 9, 12, 7, 1, -3, -8, -11, -6, -3, -2]
    values = [30 + round(slope * i) + season[i % 12] for i in range(n)]
    if outlier is not None:
        values[outlier] += 60
    return values


def test_additive_against_numpy(spark):
    counts = {"a": wave(60), "b": [3] * 30, "c": wave(20)}
    got = decomposition.additive(series_of(spark, counts), ["name"]).orderBy("name", "month").collect()
    for name, values in counts.items():
        rows, y = [r for r in got if r["name"] == name], np.array(values, float)
        assert [r["actual"] for r in rows] == values
        n = len(y)
        trend = np.full(n, np.nan)
        if n >= 24:
            for i in range(6, n - 6):
                trend[i] = (y[i - 5 : i + 6].sum() + (y[i - 6] + y[i + 6]) / 2) / 12
            shares = np.array([np.nanmean((y - trend)[k::12]) for k in range(12)])
            season = (shares - shares.mean())[np.arange(n) % 12]
            assert [r["season"] for r in rows] == pytest.approx(season.tolist())
            assert [r["rest"] for r in rows if r["rest"] is not None] == pytest.approx((y - trend - season)[6 : n - 6].tolist(), abs=1e-9)
        assert [r["trend"] is None for r in rows] == np.isnan(trend).tolist()


def test_robust_parts_sum_up_and_bear_an_outlier(spark):
    counts = {"a": wave(72), "b": wave(72, outlier=30), "c": [2] * 10}
    got = decomposition.robust(series_of(spark, counts), ["name"]).orderBy("name", "month").collect()
    by = {name: [r for r in got if r["name"] == name] for name in counts}
    assert all(r["trend"] + r["season"] + r["rest"] == pytest.approx(r["actual"]) for r in got)
    assert max(abs(r["rest"]) for r in by["a"]) < 1.5
    assert by["b"][30]["rest"] > 50 and max(abs(r["rest"]) for i, r in enumerate(by["b"]) if i != 30) < 4
    assert {r["season"] for r in by["c"]} == {0.0}
    slope = np.polyfit(range(72), [r["trend"] for r in by["a"]], 1)[0]
    assert slope == pytest.approx(0.3, abs=0.02)


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in values] if values is not None else None) for i, values in enumerate(rows)], "id bigint, y array<double>")


def test_portmanteau_against_numpy(spark):
    pick = np.random.default_rng(3)
    rows = [pick.normal(size=60), np.sin(np.arange(60)), np.ones(60), pick.normal(size=12), [], np.cumsum(pick.normal(size=100))]
    for r in decomposition.portmanteau(frame(spark, rows)).collect():
        y = np.array(rows[r["id"]], float)
        if len(y) <= 12 or np.ptp(y) == 0:
            assert r["q"] is None
            continue
        off, n = y - y.mean(), len(y)
        rho = [float(off[k:] @ off[: n - k] / (off @ off)) for k in range(1, 13)]
        assert r["autocorrelations"] == pytest.approx(rho)
        assert r["q"] == pytest.approx(n * (n + 2) * sum(p * p / (n - k) for k, p in enumerate(rho, 1)))


def dickey_fuller(y, lags):
    steps = np.diff(y)
    rows, target = [], []
    for t in range(lags, len(steps)):
        rows.append([y[t], 1.0, *[steps[t - k] for k in range(1, lags + 1)]])
        target.append(steps[t])
    x, target = np.array(rows), np.array(target)
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ target
    off = target - x @ beta
    return beta[0] / math.sqrt(off @ off / (len(target) - x.shape[1]) * inverse[0, 0])


def test_unit_root_against_plain_regression(spark):
    pick = np.random.default_rng(5)
    noise = pick.normal(size=120)
    still = [0.0]
    for e in noise:
        still.append(0.4 * still[-1] + e)
    rows = [still, np.cumsum(noise), [5.0] * 40, [1.0, 2.0], [], None]
    got = {r["id"]: r for r in decomposition.stationarity(frame(spark, rows)).collect()}
    for i in (0, 1):
        assert got[i]["unit_root"] == pytest.approx(dickey_fuller(np.array(rows[i]), got[i]["lags"]), rel=1e-6)
    assert got[0]["unit_root"] < -2.86 < got[1]["unit_root"]
    assert [got[i]["unit_root"] for i in (2, 3, 4, 5)] == [None] * 4


def test_empty_table(spark):
    none = spark.createDataFrame([], "name string, incident_date date")
    assert decomposition.additive(none, ["name"]).count() == 0 and decomposition.robust(none).count() == 0
    assert decomposition.rests(decomposition.additive(none, ["name"]), ["name"]).count() == 0
    assert decomposition.additive(spark.createDataFrame([("a", None)], "name string, incident_date date")).where(F.lit(True)).count() == 0
