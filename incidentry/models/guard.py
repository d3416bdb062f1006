"""Leakage guard: keeps the feature columns that do not give the target away."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incidentry import fixed_values as fixed

REPORT = "feature string, category string, reason string, value double, kept boolean"
SKETCH_BITS = 12  # relative error about 1.6 %
MARGIN = 0.1
WHOLE = 2.0**53  # up to here a double holds every whole number


def first_pattern(name: str, patterns: Sequence[str]) -> str | None:
    return next((pattern for pattern in patterns if pattern in name.lower()), None)


def distinct_ratios(df: DataFrame, names: Sequence[str], rows: int, rough: dict[str, int], limit: float) -> dict[str, float]:
    """Distinct share per column: approximate where that decides, exact for columns near the limit."""
    ratios = {name: rough[name] / rows for name in names} if rows else {}
    near = [name for name, ratio in ratios.items() if abs(ratio - limit) <= MARGIN]
    for name in near:
        ratios[name] = df.agg(F.count_distinct(F.col(f"`{name}`"))).first()[0] / rows
    return {name: min(ratio, 1.0) for name, ratio in ratios.items()}


class LeakageGuard(Estimator):
    """Choose columns and assemble them into ``features``.

    With ``columns_out`` only the name patterns are applied to these columns. Otherwise a column is dropped by name pattern,
    for being all null, nearly constant, too correlated with the target, or distinct in nearly every row. If nothing is left,
    the column least correlated with the target stays.
    """

    def __init__(
        self,
        candidates: Sequence[str],
        label: str = "label",
        columns_out: Sequence[str] | None = None,
        drop_patterns: Sequence[str] = tuple(fixed.LEAKY_NAME_PATTERNS),
        corr_threshold: float = 0.85,
        variance_threshold: float = 0.01,
        max_unique_ratio: float = 0.95,
        features: str = "features",
    ):
        super().__init__()
        self.candidates = list(candidates)
        self.label = label
        self.columns_out = list(columns_out or [])
        self.drop_patterns = [pattern.lower() for pattern in drop_patterns]
        self.corr_threshold = corr_threshold
        self.variance_threshold = variance_threshold
        self.max_unique_ratio = max_unique_ratio
        self.features = features

    def _fit(self, dataset: DataFrame) -> LeakageGuardModel:
        if self.columns_out:
            wanted = [name for name in self.columns_out if name in dataset.columns]
            hits = {name: first_pattern(name, fixed.LEAKY_NAME_PATTERNS) for name in wanted}
            report = [(n, "explicit_leaky_features" if hit else None, hit, None) for n, hit in hits.items()]
            correlations = None
        else:
            report, correlations = self._examine(dataset)
        dropped = {name for name, category, *_ in report if category}
        kept = [name for name in (self.columns_out or self.candidates) if name in dataset.columns and name not in dropped]
        if not kept:
            if correlations is None:
                correlations = self._statistics(dataset)[1]
            kept = [min(self.candidates, key=lambda name: correlations[name] or 0.0)]
        rows = [(name, category, reason, value, name in kept) for name, category, reason, value in report]
        return LeakageGuardModel(kept, rows, self.features)

    def _long(self, dataset: DataFrame, names: Sequence[str]) -> DataFrame:
        """(pos, value, label): a row per cell, as an aggregation of each column by itself is more code than the JVM compiles."""
        cells = F.posexplode(F.array(*[F.col(f"`{name}`").cast("double") for name in names])).alias("pos", "value")
        return dataset.select(F.col(self.label).cast("double").alias("label"), cells)

    def _statistics(self, dataset: DataFrame):
        """Everything about every candidate but distinct values, in one aggregation."""
        value, label = F.col("value"), F.col("label")
        spreads = F.stddev_pop(F.when(label.isNotNull(), value)) * F.stddev_pop(F.when(value.isNotNull(), label))
        measures = {
            "rows": F.count(F.lit(1)),
            "n": F.count(value),
            "s": F.stddev_pop(value),
            "c": F.abs(F.try_divide(F.covar_pop(value, label), spreads)),  # ``corr`` fails on a column that is constant
            "low": F.min(value),
            "high": F.max(value),
            "whole": F.bool_and(value == F.rint(value)),
        }
        row = {"rows": 0} | {f"n{i}": 0 for i in range(len(self.candidates))}
        found = self._long(dataset, self.candidates).groupBy("pos").agg(*[m.alias(name) for name, m in measures.items()])
        for one in found.collect():  # one for each candidate
            row["rows"] = one["rows"]
            row |= {f"{name}{one['pos']}": one[name] for name in measures if name != "rows"}
        finite = {}
        for i, name in enumerate(self.candidates):
            corr = row.get(f"c{i}")
            finite[name] = corr if corr is not None and corr == corr else None
        return row, finite

    def _many_valued(self, dataset: DataFrame, row, names: Sequence[str]) -> list[str]:
        """Columns that may have distinct values in nearly every row; whole numbers from a narrow range cannot."""
        found = []
        for name in names:
            i, kind = self.candidates.index(name), dataset.schema[name].dataType
            low, high = row[f"low{i}"], row[f"high{i}"]
            exact = isinstance(kind, (T.IntegralType, T.DoubleType, T.FloatType, T.BooleanType)) and row[f"whole{i}"]
            narrow = -WHOLE < low and high < WHOLE and high - low + 1 < (self.max_unique_ratio - MARGIN) * row["rows"]
            if not (exact and narrow):
                found.append(name)
        return found

    def _sketched(self, dataset: DataFrame, names: Sequence[str]) -> dict[str, int]:
        """About the number of distinct values of each column."""
        if not names:
            return {}
        hashed = F.when(F.col("value").isNotNull(), F.xxhash64("value"))
        sketch = F.hll_sketch_estimate(F.hll_sketch_agg(hashed, F.lit(SKETCH_BITS))).alias("d")
        return {names[one["pos"]]: one["d"] for one in self._long(dataset, names).groupBy("pos").agg(sketch).collect()}

    def _examine(self, dataset: DataFrame):
        row, correlations = self._statistics(dataset)
        report, alive = [], []
        for i, name in enumerate(self.candidates):
            pattern = first_pattern(name, self.drop_patterns)
            corr = correlations[name]
            if pattern:
                report.append((name, "pattern_drops", pattern, None))
            elif not row[f"n{i}"]:
                report.append((name, "all_null_drops", None, None))
            elif row[f"s{i}"] <= self.variance_threshold:
                report.append((name, "variance_drops", None, row[f"s{i}"]))
            else:
                alive.append(name)
                if corr is not None and corr >= self.corr_threshold:
                    report.append((name, "correlation_drops", None, corr))
        many = self._many_valued(dataset, row, alive)
        for name, ratio in distinct_ratios(dataset, many, row["rows"], self._sketched(dataset, many), self.max_unique_ratio).items():
            if ratio >= self.max_unique_ratio:
                report.append((name, "unique_ratio_drops", None, ratio))
        dropped = {entry[0] for entry in report}
        report += [(name, None, None, correlations[name]) for name in self.candidates if name not in dropped]
        return report, correlations


class LeakageGuardModel(Model):
    def __init__(self, kept: list[str], rows: list[tuple], features: str = "features"):
        super().__init__()
        self.kept = kept
        self.rows = rows
        self.features = features

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=self.kept, outputCol=self.features, handleInvalid="keep").transform(dataset)

    def report(self, spark) -> DataFrame:
        """One row per finding; kept columns have no category."""
        return spark.createDataFrame(self.rows, REPORT)
