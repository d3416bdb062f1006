"""Top-k, dense domains and lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incidentry import fixed_values as fixed
from incidentry.functions.common import as_column
from incidentry.session import settle

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 * 1024 * 1024
SALTS = 32


def top_values(df: DataFrame, value: str, k: int, weight: Column | None = None, count: str = "n") -> DataFrame:
    """The k most frequent values, ties by value."""
    total = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(total.alias(count))
    return counts.orderBy(F.desc(count), F.asc(value)).limit(k)


def keep_top(df: DataFrame, top: DataFrame, value: str) -> DataFrame:
    """Rows whose value is in a top-k table (k rows at most, hence the broadcast)."""
    return df.join(F.broadcast(top.select(value)), value, "left_semi")


def others_relabelled(df: DataFrame, top: DataFrame, value: str, target: str, other: str = "Other") -> DataFrame:
    """``target`` is the value when it is in the top-k table, else ``other``."""
    names = top.select(F.col(value), F.col(value).alias(target))
    return df.join(F.broadcast(names), value, "left").withColumn(target, F.coalesce(target, F.lit(other)))


def value_bytes(value: Column, kind: T.DataType) -> Column:
    """About the size of a value: texts and binaries by length, arrays, maps and structs by what they hold, others 16 bytes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(value) + 16
    elif isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
            each = F.transform(value, lambda x: F.coalesce(value_bytes(x, kind.elementType), F.lit(16)).cast("bigint"))
            size = F.aggregate(each, F.lit(16).cast("bigint"), lambda total, x: total + x)
        else:
            size = F.size(value) * 8 + 16
    elif isinstance(kind, T.MapType):
        keys, values = T.ArrayType(kind.keyType), T.ArrayType(kind.valueType)
        size = value_bytes(F.map_keys(value), keys) + value_bytes(F.map_values(value), values)
    elif isinstance(kind, T.StructType):
        parts = [value_bytes(value.getField(field.name), field.dataType) for field in kind.fields]
        size = sum((F.coalesce(part, F.lit(16)) for part in parts), F.lit(16))
    elif isinstance(kind, T.UserDefinedType):
        size = F.octet_length(value.cast("string"))
    else:
        size = F.lit(16)
    return F.coalesce(size.cast("bigint"), F.lit(16).cast("bigint"))


def counted_size(table: DataFrame) -> tuple[int, int]:
    """Rows, and bytes of their values, counted and not estimated."""
    size = sum((value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in table.schema.fields), F.lit(0).cast("bigint"))
    row = table.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return row["n"], row["bytes"]


def is_small(table: DataFrame) -> bool:
    """Within the broadcast limits."""
    rows, size = counted_size(table)
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def lookup_join(rows: DataFrame, lookup: DataFrame, on: str, spread: str | Column, how: str = "left") -> DataFrame:
    """Join a table with one row per ``on``.

    The lookup is computed once and its size is counted. A small one is broadcast; a large one is copied once per salt, and
    the rows of a hot key are spread over the salts by ``spread``. The copies are always sorted and merged: Spark estimates them by the bytes
    of the stored lookup, and would broadcast millions of rows.
    """
    lookup = settle(lookup)
    if is_small(lookup):
        return rows.join(F.broadcast(lookup), on, how)
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(as_column(spread)), F.lit(SALTS)).cast("int"))
    return salted.join(copies.hint("merge"), [on, "_salt"], how).drop("_salt")


def fixed_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def severity_domain(spark: SparkSession) -> DataFrame:
    return fixed_table(spark, [(name,) for name in fixed.SEVERITY_ORDER], "severity string")


def number_domain(spark: SparkSession, name: str, count: int) -> DataFrame:
    return spark.range(count).select(F.col("id").cast("int").alias(name))


def dense(domain: DataFrame, counts: DataFrame, keys: Sequence[str], fill: Sequence[str]) -> DataFrame:
    """Every row of a small domain, zero where nothing was counted.

    ``counts`` is an aggregate over the same keys, so it is at most as large as the domain.
    """
    return domain.join(counts, list(keys), "left").fillna(0, list(fill))


def dense_within(counts: DataFrame, key: str, inner: str, values: Column, count: str) -> DataFrame:
    """For every key that occurs, all ``values`` of the inner column, zero where nothing was counted.

    ``counts`` holds one row per key and inner value and is read once: no domain has to be derived from it a second time.
    """
    packed = counts.where(F.col(inner).isNotNull()).groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct(inner, count))).alias("_counts")
    )
    every = packed.select(key, "_counts", F.explode(values).alias(inner))
    return every.select(key, inner, F.coalesce(F.try_element_at("_counts", F.col(inner)), F.lit(0)).alias(count))
