"""Isotonic calibration against its definition, and its properties."""

import random

import numpy as np
from pyspark.sql import functions as F

from incidentry.models import calibration

SCHEMA = "id bigint, fold int, probability double, label int"


def by_definition(hits, n):
    """The largest, over starts up to a row, of the smallest mean from there to an end from the row on."""
    mean = lambda a, b: hits[a : b + 1].sum() / n[a : b + 1].sum()
    return [max(min(mean(a, b) for b in range(i, len(n))) for a in range(i + 1)) for i in range(len(n))]


def test_pooling_against_the_definition():
    pick = np.random.default_rng(1)
    for _ in range(60):
        size = int(pick.integers(1, 25))
        n = pick.integers(1, 6, size).astype(float)
        hits = np.minimum(pick.integers(0, 6, size), n).astype(float)
        low, sums, counts = calibration.pooled(np.arange(size), hits, n)
        rates = np.repeat(sums / counts, np.diff([*low, size]))
        assert np.allclose(rates, by_definition(hits, n)) and (np.diff(sums / counts) > 0).all()
        assert sums.sum() == hits.sum() and counts.sum() == n.sum()


def rows_of(seed, n=600):
    pick = random.Random(seed)
    made = []
    for i in range(n):
        p = round(pick.random(), 3)
        made.append((i, i % 3, p, int(pick.random() < p**3)))
    return made


def test_other_folds_only_rising_and_mean_preserving(spark):
    made = rows_of(2)
    df = spark.createDataFrame(made, SCHEMA).repartition(4)
    blocks = calibration.isotonic(df, fold="fold").orderBy("fold", "low").collect()
    for fold in range(3):
        own = [b for b in blocks if b["fold"] == fold]
        rest = [r for r in made if r[1] != fold]
        assert all(a["rate"] < b["rate"] for a, b in zip(own, own[1:]))
        assert sum(b["hits"] for b in own) == sum(r[3] for r in rest) and sum(b["n"] for b in own) == len(rest)
    # labels of a fold have no say in its own rates
    flipped = spark.createDataFrame([(i, f, p, 1 - y if f == 1 else y) for i, f, p, y in made], SCHEMA)
    rates = lambda d: {r["id"]: r["calibrated"] for r in calibration.calibrated(d, fold="fold").where("fold = 1").collect()}
    assert rates(df) == rates(flipped)


def test_calibrated_scores_are_closer_to_rates(spark):
    df = spark.createDataFrame(rows_of(3, 3000), SCHEMA)
    better = calibration.calibrated(df, fold="fold")
    off = lambda d, score: calibration.reliability(d, score).agg(F.sum(F.col("rows") * F.col("apart")) / F.sum("rows")).first()[0]
    assert off(better, "calibrated") < 0.4 * off(df, "probability")
    whole = calibration.calibrated(df)
    assert abs(whole.agg(F.avg("calibrated")).first()[0] - df.agg(F.avg("label")).first()[0]) < 1e-9


def test_awkward_rows(spark):
    rows = [(1, 0, 0.5, 1), (2, 0, None, 1), (3, 1, 0.7, None), (4, None, 0.2, 0), (5, 1, 1.5, 1), (6, 1, -2.0, 0), (7, 1, 0.5, 0), (7, 1, 0.5, 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("calibrated", F.lit("old"))
    got = calibration.calibrated(df, fold="fold").collect()
    assert len(got) == len(rows) and {r["id"] for r in got if r["calibrated"] is None} == {2, 4}
    assert [r["rows"] for r in calibration.reliability(df).orderBy("tenth").collect()] and calibration.reliability(df).agg(F.sum("rows")).first()[0] == 6
    none = df.where("id < 0")
    assert calibration.calibrated(none, fold="fold").count() == 0 and calibration.reliability(none).count() == 0
    assert calibration.isotonic(df.where("fold = 1"), fold="fold").count() == 0
