"""Whitening against a plain eigendecomposition, exact deviations, and awkward vectors."""

import math
from fractions import Fraction

import numpy as np
import pytest

from incidentry.llm import whitening
from incidentry.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain(vectors):
    """Whole numbers, distinct vectors, exact deviations, and the eigendecomposition of the exact covariance."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(column) for column in zip(*fit)]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(row, sums)] for row in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return n, sums, x, deviations, values[::-1], axes[:, ::-1]


def check(rows, ids, vectors, components=16):
    n, sums, x, deviations, values, axes = plain(vectors)
    assert len(rows) == len(ids) * min(components, len(sums))
    signs = {}
    by_id = {key: i for i, key in enumerate(ids)}
    for row in rows:
        i, k = by_id[row["vec_id"]], row["component"] - 1
        assert row["n"] == n and row["deviation"] == deviations[i]
        expected = float(np.array([float(Fraction(n * c - s, n)) for c, s in zip(x[i], sums)]) @ axes[:, k] / np.sqrt(values[k]))
        sign = signs.setdefault(k, 1.0 if abs(row["whitened"] - expected) <= abs(row["whitened"] + expected) else -1.0)
        assert row["whitened"] == pytest.approx(sign * expected, abs=1e-7)
        assert row["explained"] == pytest.approx(values[k] / values.sum(), rel=1e-9)
        assert row["identity_error"] < 1e-9


def test_table_against_plain_version(spark):
    rows = QUERIES["op11_whitening"](spark, FOLDER).collect()
    given = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    check(rows, [r["vec_id"] for r in given], [r["embedding"] for r in given])


def test_copies_weigh_nothing_and_components_hold_for_all_rows(spark):
    pick = np.random.default_rng(3)
    vectors = [list(map(float, v)) for v in pick.standard_normal((60, 5)) * [9, 4, 2, 1, 0.5]]
    rows = [(i, vectors[i % 60] if i < 120 else vectors[7]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(7)
    found = whitening.whiten(df).collect()
    check(found, [i for i, _ in rows], [v for _, v in rows])


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0, 3.0], "a"),
        (1, [1.0, 2.0, 3.0], "a"),
        (2, [2.0, -1.0, 0.5], None),
        (None, [0.25, 0.5, 8.0], "c"),
        (3, [9.0, 9.0, -9.0], ""),
        (4, None, "x"),
        (5, [1.0, None, 2.0], "x"),
        (6, [1.0, nan, 2.0], "x"),
        (7, [-inf, 1.0, 2.0], "x"),
        (8, [], "x"),
        (9, [1.0], "x"),
    ]
    names = "component n deviation whitened explained identity_error _x".split()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string")
    for name in names:
        df = df.selectExpr("*", f"'old' AS {name}")
    found = whitening.whiten(df)
    assert found.columns == ["vec_id", "embedding", "label", "_x", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = found.collect()
    assert {r["n"] for r in got} == {4} and len(got) == 5 * 3
    assert sorted({r["vec_id"] or 0 for r in got}) == [0, 1, 2, 3]


def test_no_spread_or_no_rows(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "vec_id bigint, embedding array<float>")
    assert whitening.whiten(same).count() == 0
    assert whitening.whiten(same.where("vec_id < 0")).count() == 0
    one_way = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], "vec_id bigint, embedding array<float>")
    assert {r["component"] for r in whitening.whiten(one_way).collect()} == {1}


def test_huge_entries_are_exact(spark):
    vectors = [[1e15, 1.0], [-1e15, 2.0], [3e14, 4.0], [1e300, -1e300]]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(df).where("component = 1").collect()}
    top = 1 << 61
    x = [[max(-top, min(top, math.floor(64 * c))) + 1_000_000 for c in v] for v in vectors]
    sums = [sum(c) for c in zip(*x)]
    exact = [sum((4 * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    assert got == {i: v if v < 10**38 else None for i, v in enumerate(exact)}


@pytest.mark.parametrize("d", [1, 2, 3, 17, 64])
@pytest.mark.parametrize("kind", ["spread", "equal", "repeated", "tiny", "diagonal"])
def test_leading_eigenvectors(d, kind):
    pick = np.random.default_rng(d)
    axes = np.linalg.qr(pick.standard_normal((d, d)))[0] if kind != "diagonal" else np.eye(d)
    values = {
        "spread": pick.random(d),
        "equal": np.ones(d),
        "repeated": np.repeat(pick.random(d), 4)[:d],
        "tiny": 10.0 ** -np.arange(d),
        "diagonal": np.where(np.arange(d) % 3 == 0, 2.0, 0.0),
    }[kind]
    matrix = axes * values @ axes.T
    matrix = (matrix + matrix.T) / 2
    found, vectors = whitening.leading(matrix, 16)
    assert found == pytest.approx(np.sort(np.linalg.eigvalsh(matrix))[::-1][:16], abs=1e-14 * max(1, d))
    assert np.abs(vectors.T @ vectors - np.eye(len(found))).max() < 1e-12
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-13 * max(1, d)
