"""Operators that split hot keys, against plain loops, with a third of the rows on one key."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from incidentry.operators import gate, history, joins, ordered

START = datetime(2024, 1, 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_histories_match_a_loop(spark, seed):
    dice = random.Random(seed)
    made = []
    for i in range(600):
        key = dice.choice(["hot", "hot", None] + [f"k{n}" for n in range(4)])
        at = None if dice.random() < 0.15 else START + timedelta(minutes=dice.randrange(0, 4000, 7))
        made.append((i * 700_000, key, at))
    df = spark.createDataFrame(made, "incident_id bigint, k string, incident_datetime timestamp_ntz")
    seen, expected, totals = defaultdict(int), {}, defaultdict(int)
    for i, key, at in sorted(made, key=lambda r: (r[2] is None, r[2] or START, r[0])):
        expected[i] = None if key is None else seen[key]
        seen[key] += 1
        totals[key] += 1
    got = history.with_counts(df, "k", "prior", "total").collect()
    assert {r["incident_id"]: r["prior"] for r in got} == expected
    assert all(r["total"] == (None if r["k"] is None else totals[r["k"]]) for r in got)


def test_history_shuffles_by_key_and_hour(spark):
    df = spark.range(10).selectExpr(
        "id AS incident_id", "CAST(id % 3 AS string) AS k", "timestamp_ntz'2024-01-01' + id * interval 1 hour AS incident_datetime"
    )
    plan = history.with_counts(df, "k", "p", "t")._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    rows = [line for line in moved if "_bucket1" in line]
    assert "SinglePartition" not in plan
    # rows and the finest sums move by key and both buckets; what is gathered by fewer columns are sums of buckets
    assert len(rows) >= 2 and len(moved) - len(rows) <= 4


def test_history_of_one_hot_instant(spark):
    """All rows on one key and one time: only blocks of ids can split them."""
    df = spark.range(0, 4_000_000, 20_000).select(
        F.col("id").alias("incident_id"), F.lit("k").alias("k"), F.expr("timestamp_ntz'2024-01-01'").alias("incident_datetime")
    )
    got = [r["p"] for r in history.with_counts(df, "k", "p", "t").orderBy("incident_id").collect()]
    assert got == list(range(200))


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [3.0] * 50 + [1e9], list(np.random.default_rng(3).normal(size=400))])
def test_percentiles_match_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    got = ordered.exact_percentiles(df, {"a": ("v", 0.1), "b": ("v", 0.5), "c": ("v", 0.8), "d": ("v", 1.0)}).first()
    assert np.allclose([got[n] for n in "abcd"], np.percentile(values, [10, 50, 80, 100]))


@pytest.mark.parametrize("seed", range(3))
def test_percentiles_of_large_columns(spark, monkeypatch, seed):
    """Outliers, many ties and few distinct values; ranges are narrowed down to five rows."""
    monkeypatch.setattr(ordered, "FEW_ROWS", 5)
    monkeypatch.setattr(ordered, "SKETCH_MARGIN", [1e-4, 0.02, 0.2][seed])
    dice = np.random.default_rng(seed)
    wide = np.append(dice.normal(size=2999), 1e15)
    ties = dice.choice([1.0, 2.0, 7.0], size=3000, p=[0.495, 0.5, 0.005])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(wide, ties)], "wide double, ties double")
    shares = [0.0, 0.2, 0.4949, 0.495, 0.5, 0.9951, 1.0]
    wanted = {f"{name}{i}": (name, share) for name in ("wide", "ties") for i, share in enumerate(shares)}
    got = ordered.exact_percentiles(df, wanted).first()
    for name, values in (("wide", wide), ("ties", ties)):
        assert np.allclose([got[f"{name}{i}"] for i in range(len(shares))], np.quantile(values, shares))


def test_nothing_is_left_behind(spark):
    from catalog.queries import QUERIES
    from incidentry import session

    session.clear_scratch(spark)
    for name in ("f15_high_risk_pairs", "cl1_embedding_clusters", "ml8_cross_validation", "w7_cooldown"):
        QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    made = list(session._MADE)
    session.clear_scratch(spark)
    assert made and not session._MADE
    import os

    assert not any(os.path.exists(path.removeprefix("file:")) for path in made)
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def folded(alerts, cooldown):
    last, passed = {}, set()
    for i, key, at in sorted(alerts, key=lambda r: (r[2], r[0])):
        if key not in last or at - last[key] >= cooldown:
            last[key] = at
            passed.add(i)
    return passed


@pytest.mark.parametrize("seed, chunk, calm", [(1, 3, 0), (2, 1, 0), (3, 24, 20), (4, 5, 1000)])
def test_gate_matches_a_fold(spark, seed, chunk, calm):
    dice = random.Random(seed)
    made = []
    for i in range(700):
        key = dice.choice(["hot", "hot", "a", "b", f"c{i % 40}"])
        made.append((i, key, START + timedelta(seconds=dice.choice([dice.randrange(20_000), dice.randrange(0, 20_000, 50)]))))
    df = spark.createDataFrame(made, "id bigint, k string, t timestamp_ntz")
    got = gate.with_gate(df, ["k"], "t", "id", 60, chunk, calm).collect()
    assert len(got) == len(made)
    assert {r["id"] for r in got if r["allowed"]} == folded(made, timedelta(seconds=60))


def test_large_lookup_is_salted_and_complete(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    df = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"))
    lookup = df.where("id % 2 = 0").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = joins.lookup_join(df, lookup, "k", "id")
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString() or "_salt" in got._jdf.queryExecution().toString()
    assert got.count() == 300
    assert got.where("k = 'hot' and n = 50").count() == 100
    assert got.where("n is null").count() == 100


def test_copies_of_a_large_lookup_are_not_broadcast(spark, monkeypatch):
    """The bytes that Spark estimates are those of the stored lookup, not of its copies."""
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    got = joins.lookup_join(spark.range(300), spark.range(300).withColumn("n", F.col("id") * 2), "id", "id")
    assert got.where("n = 2 * id").count() == 300
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_gate_rows_are_dealt_out_once_with_short_keys(spark, monkeypatch):
    """Null tie breakers, empty ones and rows without a time among them."""
    monkeypatch.setattr(gate, "settle", lambda df: df)
    made = [(i, "k", None if i % 7 == 0 else START + timedelta(minutes=i // 4 * 30), [None, "", "b", "b"][i % 4]) for i in range(40)]
    df = spark.createDataFrame(made, "id bigint, k string, t timestamp_ntz, tie string")
    got = gate.with_gate(df.repartition(3), ["k"], "t", "tie", 3600)
    passed = [r for r in got.collect() if r["allowed"]]
    times = {}
    for _, _, at, tie in made:
        if at is not None and (tie is not None or at not in times):
            times[at] = min(tie, times[at]) if times.get(at) is not None else tie
    last, expected = None, []
    for at, tie in sorted(times.items()):
        if last is None or at - last >= timedelta(hours=1):
            expected.append((at, tie))
            last = at
    assert sorted((r["t"], r["tie"]) for r in passed) == expected and got.count() == 40 and got.columns == [*df.columns, "allowed"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = gate.with_gate(df, ["k"], "t", "tie", 3600)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rows = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and "_tie" in line]
    assert len(rows) == 2 and "sha2" in plan and "unhex" in plan  # the rows, and the alerts that pass
