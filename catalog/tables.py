"""Input tables of the registered queries, and the plain output form both engines share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incidentry.functions.clock import delay_days
from incidentry.plans.prepare import derive, prepare
from incidentry.session import use_utc
from incidentry.sources.orders_view import incidents

AS_OF = "2024-06-30"


def plain(df: DataFrame) -> DataFrame:
    """Doubles to six digits, truth values to 0/1, dates and times to text, lists to one text."""
    shown = []
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            value = F.round(value.cast("double"), 6) + F.lit(0.0)
        elif isinstance(field.dataType, T.BooleanType):
            value = value.cast("int")
        elif isinstance(field.dataType, T.DateType):
            value = F.date_format(value, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.TimestampNTZType, T.TimestampType)):
            value = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, T.ArrayType):
            value = F.array_join(value, " | ")
        shown.append(value.alias(field.name))
    return df.select(*shown)


def raw(spark: SparkSession, folder: str) -> DataFrame:
    return incidents(spark, folder)


def derived(spark: SparkSession, folder: str) -> DataFrame:
    return derive(incidents(spark, folder))


def prepared(spark: SparkSession, folder: str) -> DataFrame:
    return prepare(incidents(spark, folder))


def delayed(spark: SparkSession, folder: str) -> DataFrame:
    """Derived rows with the delay in whole days, which alerts and summaries read."""
    days = delay_days("incident_date", "notification_date").cast("double")
    return derived(spark, folder).withColumn("notification_delay_days", days)


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """A scored table with a known answer: the score leans towards the label."""
    label = F.when(F.col("severity_numeric") >= 3, 1).otherwise(0)
    score = (F.pmod(F.col("incident_id") * 37, F.lit(700)) + label * 300) / F.lit(1000.0)
    return derived(spark, folder).select(
        "incident_id",
        label.alias("label"),
        F.when(score > 0.5, 1).otherwise(0).alias("prediction"),
        score.alias("probability"),
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{folder}/events.parquet")


def embedding_columns(spark: SparkSession, folder: str, size: int = 64) -> DataFrame:
    """Embeddings as one column per dimension."""
    use_utc(spark)
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    return table.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(size)])
