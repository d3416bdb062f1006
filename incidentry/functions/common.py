"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: str | Column) -> Column:
    """Without white space of any kind at both ends; ``trim`` alone removes blanks only."""
    return F.trim(as_column(value), F.lit(" \t\n\r\x0b\x0c"))


def title_case(value: str | Column) -> Column:
    """Capital after every non-letter ('Self-Harm'), where ``initcap`` looks at blanks only."""
    pieces = F.split(as_column(value), "(?<=[^A-Za-z])")
    return F.array_join(F.transform(pieces, F.initcap), "")


def clean_label(value: str | Column) -> Column:
    return title_case(strip(F.translate(as_column(value), "_", " ")))


def pick(value: Column, table: Mapping, otherwise=None) -> Column:
    """Value looked up in a small fixed table."""
    chain = None
    for key, result in table.items():
        chain = F.when(value == key, result) if chain is None else chain.when(value == key, result)
    return chain.otherwise(otherwise)


def banded(value: Column, bands: Iterable[tuple], hit: Callable[[Column, float], Column]) -> Column:
    """Label of the first band hit; a null value falls in the last band, as every comparison with it fails."""
    chain, last = None, None
    for bound, label in bands:
        if bound is None:
            last = label
        else:
            chain = F.when(hit(value, bound), label) if chain is None else chain.when(hit(value, bound), label)
    return chain.otherwise(last)


def count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def share(condition: Column) -> Column:
    """Mean of a truth value; null counts as false."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def finite_or_zero(name: str) -> Column:
    value = F.col(name).cast("double")
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, 0.0).otherwise(value)


def beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table, read as a scalar subquery."""
    packed = one_row.select(F.struct("*").alias("row")).scalar()
    return df.withColumn("_row", packed).select(*df.columns, "_row.*")


def whole_number(value: str | Column) -> Column:
    """Integer part, or null when there is none."""
    return as_column(value).try_cast("double").try_cast("bigint")
