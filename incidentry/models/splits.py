"""Training and test rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentry.functions.clock import micros
from incidentry.operators.joins import lookup_join
from incidentry.operators.ordered import exact_percentiles, hash_bucket, running_sums


def time_split(df: DataFrame, time: str = "incident_datetime", portion: float = 0.75) -> DataFrame:
    """``is_test``: later than the percentile of time; rows without a time are in neither part."""
    cut = exact_percentiles(df.select(micros(time).alias("_at")), {"cut": ("_at", portion)}).first()["cut"]
    at = micros(time)
    return df.where(at.isNotNull()).withColumn("is_test", at > F.lit(cut))


def group_split(df: DataFrame, group: str, test_size: float = 0.25, seed: int = 42, spread: str = "incident_id") -> DataFrame:
    """``is_test`` for whole groups: the share ``test_size`` of the groups, in the order of a hash."""
    keyed = df.withColumn(group, F.coalesce(F.col(group).cast("string"), F.lit("NA")))
    groups = keyed.select(group).distinct().withColumn("_hash", F.xxhash64(group, F.lit(seed)))
    ranked = running_sums(
        groups,
        order=[F.col("_hash"), F.col(group)],
        buckets=[hash_bucket("_hash")],
        sums={"_before": F.lit(1).cast("bigint")},
        totals={"_before": "_groups"},
    )
    chosen = ranked.select(group, (F.col("_before") < F.ceil(F.col("_groups") * test_size)).alias("is_test"))
    return lookup_join(keyed, chosen, group, spread)


def _ranked_by_class(df: DataFrame, label: str, row_id: str, seed: int) -> DataFrame:
    """Position of each row inside its class, in the order of a hash of its id. A class may hold most of the rows."""
    return running_sums(
        df.withColumn("_hash", F.xxhash64(row_id, F.lit(seed))),
        order=[F.col("_hash"), F.col(row_id)],
        buckets=[hash_bucket("_hash")],
        sums={"_before": F.lit(1).cast("bigint")},
        by=[label],
        totals={"_before": "_class_rows"},
    ).drop("_hash")


def stratified_split(
    df: DataFrame, label: str = "label", test_size: float = 0.25, seed: int = 42, row_id: str = "incident_id"
) -> DataFrame:
    """``is_test`` for the share ``test_size`` of each class."""
    ranked = _ranked_by_class(df, label, row_id, seed)
    return ranked.withColumn("is_test", F.col("_before") < F.round(F.col("_class_rows") * test_size)).drop(
        "_before", "_class_rows"
    )


def with_folds(df: DataFrame, folds: int, label: str = "label", seed: int = 42, row_id: str = "incident_id") -> DataFrame:
    """``fold`` 0..folds-1, the classes spread evenly."""
    ranked = _ranked_by_class(df, label, row_id, seed)
    return ranked.withColumn("fold", F.pmod(F.col("_before"), F.lit(folds)).cast("int")).drop("_before", "_class_rows")
