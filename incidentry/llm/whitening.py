"""Whitening of vectors by principal components of their covariance.

Entries become whole numbers, so that counts, sums and deviations are exact. The fit list, each distinct vector once, is stored in the shared
folder; tasks reduce their rows to counts, centres and centred products, and these partial results are merged by further tasks. The driver gets
one covariance matrix, whose size is the square of the number of dimensions, and finds the leading components: Householder reflections make it
tridiagonal, Sturm counts bisect the eigenvalues, inverse iteration gives the vectors, which are made orthogonal again within clusters of
eigenvalues that lie close together. The projection is broadcast and applied to every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentry.llm.common import fresh, store, without

SCALE, OFFSET, COMPONENTS = 64.0, 1_000_000, 16
LARGEST = float(1 << 61)
MOST_DIMENSIONS = 4096
SPREAD = 64
RESULTS = ("component", "n", "deviation", "whitened", "explained", "identity_error")


def whole(vector: Column) -> Column:
    """floor(SCALE * c) + OFFSET of every entry; entries beyond 2^61 count as 2^61."""

    def entry(c: Column) -> Column:
        scaled = F.least(F.greatest(c.cast("double") * F.lit(SCALE), F.lit(-LARGEST)), F.lit(LARGEST))
        return F.floor(scaled).cast("bigint") + F.lit(OFFSET).cast("bigint")

    return F.transform(vector, entry)


def finite(vector: Column) -> Column:
    """True where the vector has at least one entry, and each is a finite number."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


# Moments: partial results (n, mean, products) of rows of one width, each centred at its own mean before multiplying


def moments(rows: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    mean = rows.mean(axis=0)
    centred = rows - mean
    rest = centred.mean(axis=0)  # what rounding has left
    centred -= rest
    return len(rows), mean + rest, centred.T @ centred


def merged(a: tuple, b: tuple) -> tuple[int, np.ndarray, np.ndarray]:
    """The moments of the rows of both."""
    n = a[0] + b[0]
    apart = b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * (b[0] / n))


def _packed(part: tuple) -> dict:
    return {"n": part[0], "mean": part[1].tobytes(), "products": part[2].tobytes()}


def _unpacked(table: pa.Table | pa.RecordBatch) -> Iterator[tuple]:
    for n, mean, products in zip(*(table.column(name).to_pylist() for name in ("n", "mean", "products"))):
        centre = np.frombuffer(mean)
        yield n, centre, np.frombuffer(products).reshape(len(centre), len(centre))


_MOMENTS = pa.schema([("n", pa.int64()), ("mean", pa.binary()), ("products", pa.binary())])


def _merged_all(parts: DataFrame) -> tuple | None:
    """One result of all partial ones (salt, n, mean, products): first of those with equal salts, in tasks, then of these at most SPREAD."""

    def together(table: pa.Table) -> pa.Table:
        found = None
        for part in _unpacked(table):
            found = part if found is None else merged(found, part)
        return pa.Table.from_pylist([_packed(found)], schema=_MOMENTS)

    found = None
    for row in parts.groupBy("salt").applyInArrow(together, "n bigint, mean binary, products binary").collect():
        centre = np.frombuffer(row["mean"])
        part = row["n"], centre, np.frombuffer(row["products"]).reshape(len(centre), len(centre))
        found = part if found is None else merged(found, part)
    return found


def _matrix(column: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _reduced(rows: DataFrame, turn) -> tuple | None:
    """The moments of ``turn(matrix of x)`` over all rows (x)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found = None
        for batch in batches:
            if batch.num_rows:
                part = moments(turn(_matrix(batch.column(0))))
                found = part if found is None else merged(found, part)
        if found:
            salt = TaskContext.get().partitionId() % SPREAD
            yield pa.RecordBatch.from_pylist([{"salt": salt} | _packed(found)], schema=pa.schema([("salt", pa.int32()), *_MOMENTS]))

    return _merged_all(rows.select("x").mapInArrow(partial, "salt int, n bigint, mean binary, products binary"))


# Leading eigenvectors of a symmetric matrix


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Diagonal, subdiagonal and the Householder reflections (first row, unit vector) that lead there."""
    a = np.array(matrix, np.float64)
    d, reflections = len(a), []
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if size == 0 or not np.any(v[1:]):
            continue
        v /= size
        v[0] += np.copysign(1.0, v[0])
        v /= np.linalg.norm(v)
        block = a[k + 1 :, k + 1 :]
        p = block @ v
        p -= v * (v @ p)
        block -= 2 * (np.outer(v, p) + np.outer(p, v))
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
        reflections.append((k + 1, v))
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def below(diagonal: np.ndarray, beside: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each of ``at``: the negative terms of the Sturm sequence of quotients."""
    tiny = np.finfo(np.float64).tiny / np.finfo(np.float64).eps
    squares = np.append(0.0, beside * beside)
    q, count = np.ones_like(at), np.zeros(len(at), np.int64)
    for value, square in zip(diagonal, squares):
        q = value - at - square / q
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def eigenvalues(diagonal: np.ndarray, beside: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` largest, falling, each bisected until its bounds are neighbouring doubles or nearly so."""
    reach = np.append(np.abs(beside), 0) + np.append(0, np.abs(beside))
    d = len(diagonal)
    low = np.full(most, (diagonal - reach).min())
    high = np.full(most, (diagonal + reach).max())
    span = np.maximum(np.abs(low), np.abs(high))
    low, high = low - span * 1e-12 - 1e-300, high + span * 1e-12 + 1e-300
    wanted = d - np.arange(most)  # of the eigenvalues, this many are at or below the one looked for
    for _ in range(2200):
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high)):
            break
        less = below(diagonal, beside, middle) < wanted
        low, high = np.where(less, middle, low), np.where(less, high, middle)
    return low + (high - low) / 2


def _solved(diagonal: np.ndarray, beside: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """(T - shift) x = right by elimination with row exchanges; pivots are at least ``least``."""
    d = len(diagonal)
    main, upper, second, x = diagonal - shift, np.append(beside, 0.0), np.zeros(d), right.copy()
    for k in range(d - 1):
        under = beside[k]
        if abs(main[k]) >= abs(under):
            pivot = main[k] if abs(main[k]) > least else np.copysign(least, main[k])
            main[k] = pivot
            factor = under / pivot
            main[k + 1] -= factor * upper[k]
            x[k + 1] -= factor * x[k]
        else:
            factor = main[k] / under
            main[k], old = under, upper[k]
            upper[k], main[k + 1] = main[k + 1], old - factor * main[k + 1]
            second[k] = upper[k + 1]
            upper[k + 1] = -factor * upper[k + 1]
            x[k], x[k + 1] = x[k + 1], x[k] - factor * x[k + 1]
    if abs(main[-1]) < least:
        main[-1] = np.copysign(least, main[-1])
    for k in range(d - 1, -1, -1):
        rest = x[k]
        if k + 1 < d:
            rest -= upper[k] * x[k + 1]
        if k + 2 < d:
            rest -= second[k] * x[k + 2]
        x[k] = rest / main[k]
        if abs(x[k]) > 1e150:
            x /= abs(x[k])
    return x


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues, falling, and their unit eigenvectors as columns."""
    size = np.abs(matrix).max() if matrix.size else 0.0
    d, most = len(matrix), min(most, len(matrix))
    if size == 0 or not np.isfinite(size):
        return np.zeros(most), np.eye(d)[:, :most]
    diagonal, beside, reflections = tridiagonal(matrix / size)
    values = eigenvalues(diagonal, beside, most)
    norm = max(np.abs(diagonal).max(), np.abs(beside).max() if d > 1 else 0.0)
    least, close = norm * np.finfo(np.float64).eps, 1e-3 * norm
    pick = np.random.default_rng(0)
    vectors = np.zeros((d, most))
    first = 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > close:
            first = k  # a new cluster
        x = pick.standard_normal(d)
        for _ in range(5):
            x = _solved(diagonal, beside, value, x / np.linalg.norm(x), least)
            x /= np.linalg.norm(x)
            for _ in range(2):
                x -= vectors[:, first:k] @ (vectors[:, first:k].T @ x)
                x /= np.linalg.norm(x)
        vectors[:, k] = x
    for row, v in reversed(reflections):
        vectors[row:] -= 2 * np.outer(v, v @ vectors[row:])
    return values * size, vectors


# The operator


@dataclass
class Model:
    """Of the fit list: number, exact sums, and the components with their eigenvalues and shares; ``error`` is that of the whitened fit list."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    error: float = 0.0

    def __post_init__(self) -> None:
        parts = [divmod(s, self.n) for s in self.sums]
        self.whole = np.array([q for q, _ in parts], np.int64)
        self.over = np.array([r for _, r in parts], object)
        self.rest = np.array([r / self.n for _, r in parts])
        self.projection = self.vectors / np.sqrt(self.values)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: the difference of whole numbers first."""
        return (x - self.whole).astype(np.float64) - self.rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.projection

    def deviations(self, x: np.ndarray) -> list:
        """The sum over dimensions of (n x - S)^2 for each row, exact; None where it has over 38 digits."""
        apart = x - self.whole
        most = max(1, int(np.abs(apart).max(initial=0)) + 1) * self.n
        if x.shape[1] * most * most < 1 << 62:
            exact = apart * self.n - self.over.astype(np.int64)
            return [int(v) for v in (exact * exact).sum(axis=1)]
        exact = apart.astype(object) * self.n - self.over
        sums = [sum(v * v for v in row) for row in exact.tolist()]
        return [v if v < 10**38 else None for v in sums]


def fit(distinct: DataFrame, dimensions: int, components: int = COMPONENTS) -> Model | None:
    """A model of the vectors ``x`` of whole numbers, which are distinct and of one length; None without any."""
    if dimensions > MOST_DIMENSIONS:
        raise ValueError(f"a covariance of {dimensions} dimensions is not held on the driver")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dimensions, object)
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                n += len(x)
                total += (x >> 31).sum(axis=0).astype(object) * (1 << 31) + (x & ((1 << 31) - 1)).sum(axis=0).astype(object)
        if n:
            # two halves each, so that a sum of many tasks' sums stays exact as a decimal
            columns = [pa.array(list(range(-1, dimensions)), pa.int32()), pa.array([Decimal(int(v)) for v in [n, *total]], pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(columns, ["place", "total"])

    found = distinct.select("x").mapInArrow(sums, "place int, total decimal(38,0)").groupBy("place").agg(F.sum("total").alias("total")).collect()
    totals = {row["place"]: int(row["total"]) for row in found}
    if not totals:
        return None
    n, parts = totals[-1], [totals[i] for i in range(dimensions)]
    blank = Model(n, parts, np.ones(0), np.zeros((dimensions, 0)), np.zeros(0))
    _, off, products = _reduced(distinct, blank.centred)
    covariance = products / n + np.outer(off, off)  # about S / n; off is what rounding has left of the mean
    covariance = (covariance + covariance.T) / 2
    values, vectors = leading(covariance, components)
    trace = float(np.trace(covariance))
    real = values > max(values[0], 0.0) * dimensions * np.finfo(np.float64).eps if len(values) else values > 0
    values, vectors = values[real], vectors[:, real]
    model = Model(n, parts, values, vectors, values / trace if trace > 0 else values)
    if len(values):
        _, _, products = _reduced(distinct, model.whitened)
        model.error = float(np.abs(products / n - np.eye(len(values))).max())
    return model


def whiten(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per vector and leading component: all columns of ``vectors``, then component, n, deviation, whitened, explained, identity_error.

    Left out are vectors that are null or empty or hold null or non-finite entries, and those whose length is not the commonest one (of equally
    common lengths the largest). The model is fitted on each distinct vector once, so copies weigh nothing; rows are returned as often as
    they come. Components whose eigenvalue is zero up to rounding have no whitened value and give no row, so equal vectors, or a single one,
    give none. ``deviation`` is decimal(38,0), null where it has more digits. Columns with the name of a result are replaced.
    """
    rows = without(vectors, *(name for name in RESULTS if name != column.lower()))
    x, facts = fresh(rows, "_x", "_facts")
    rows = rows.where(finite(F.col(f"`{column}`")))
    rows = rows.withColumn(x, whole(F.col(f"`{column}`")))
    lengths = rows.groupBy(F.size(F.col(x)).alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("length")).limit(1).collect()
    dimensions = lengths[0]["length"] if lengths else 0
    rows = rows.where(F.size(F.col(x)) == dimensions)
    model = None
    if dimensions:
        model = fit(store(rows.select(F.col(x).alias("x")).distinct(), "fit-list"), dimensions, components)
    kept = [F.col(f"`{name}`") for name in rows.columns if name != x]
    kind = "struct<deviation:decimal(38,0), whitened:array<double>>"
    if model is None or not len(model.values):
        none = F.lit(None)
        kinds = dict(zip(RESULTS, ("int", "bigint", "decimal(38,0)", "double", "double", "double")))
        return rows.where(F.lit(False)).select(*kept, *[none.cast(kinds[name]).alias(name) for name in RESULTS])
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # dimensions x components doubles

    @F.arrow_udf(kind)
    def projected(values: pa.Array) -> pa.Array:
        matrix = _matrix(values)
        if not len(values):
            matrix = matrix.reshape(0, dimensions)
        out = shared.value.whitened(matrix)
        deviation = pa.array([None if v is None else Decimal(v) for v in shared.value.deviations(matrix)], pa.decimal128(38, 0))
        ends = np.arange(len(matrix) + 1, dtype=np.int32) * out.shape[1]
        return pa.StructArray.from_arrays([deviation, pa.ListArray.from_arrays(ends, out.ravel())], ["deviation", "whitened"])

    rows = rows.withColumn(facts, projected(F.col(x)))
    shares = F.array(*[F.lit(float(v)) for v in model.explained])
    rows = rows.select(*kept, F.col(f"{facts}.deviation").alias("deviation"), F.posexplode(f"{facts}.whitened").alias("component", "whitened"))
    return rows.select(
        *kept,
        (F.col("component") + 1).alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.element_at(shares, F.col("component") + 1).alias("explained"),
        F.lit(model.error).alias("identity_error"),
    )
