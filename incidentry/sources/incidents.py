"""Reading, conforming and writing incident tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incidentry.functions.clock import day_name

SCHEMA = T.StructType(
    [
        T.StructField("incident_id", T.LongType()),
        T.StructField("incident_date", T.TimestampNTZType()),
        T.StructField("incident_time", T.StringType()),
        T.StructField("notification_date", T.TimestampNTZType()),
        T.StructField("notification_time_frame", T.StringType()),
        T.StructField("notification_delay_days", T.DoubleType()),
        T.StructField("incident_type", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("reportable", T.BooleanType()),
        T.StructField("medical_attention_required", T.BooleanType()),
        T.StructField("treatment_required", T.BooleanType()),
        T.StructField("actions_documented", T.BooleanType()),
        T.StructField("medical_outcome", T.StringType()),
        T.StructField("contributing_factors", T.StringType()),
        T.StructField("cause", T.StringType()),
        T.StructField("root_cause", T.StringType()),
        T.StructField("participant_id", T.StringType()),
        T.StructField("carer_id", T.StringType()),
        T.StructField("reported_by", T.StringType()),
        T.StructField("participant_age", T.IntegerType()),
        T.StructField("dob", T.TimestampNTZType()),
        T.StructField("location", T.StringType()),
        T.StructField("address", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("report_id", T.StringType()),
        T.StructField("narrative", T.StringType()),
    ]
)
DATE_COLUMNS = ["incident_date", "notification_date", "dob"]
REQUIRED = ["incident_date", "severity"]


def conform(df: DataFrame) -> DataFrame:
    """Add missing optional columns as typed nulls, leave the others as they are, and check the required ones."""
    missing = [name for name in REQUIRED if name not in df.columns]
    if missing:
        raise ValueError(f"incident table lacks {', '.join(missing)}")
    if "reported_by" not in df.columns and not {"participant_id", "carer_id"} <= set(df.columns):
        raise ValueError("incident table needs reported_by when participant_id or carer_id is absent")
    absent = {
        f.name: F.lit(None).cast(f.dataType)
        for f in SCHEMA.fields
        if f.name not in df.columns and f.name not in ("incident_id", "participant_id", "carer_id", "location")
    }
    return df.withColumns(absent) if absent else df


def parse_dates(df: DataFrame) -> DataFrame:
    """Date columns given as text become timestamps, null where they do not parse."""
    found = {
        name: F.col(name).try_cast("timestamp_ntz")
        for name in DATE_COLUMNS
        if name in df.columns and isinstance(df.schema[name].dataType, T.StringType)
    }
    return df.withColumns(found) if found else df


def drop_undated(df: DataFrame) -> DataFrame:
    return df.na.drop(subset=["incident_date"])


def with_weekday(df: DataFrame) -> DataFrame:
    """Weekday name, kept when the column is there already."""
    if "incident_weekday" in df.columns:
        return df
    return df.withColumn("incident_weekday", day_name("incident_date"))


def load(raw: DataFrame) -> DataFrame:
    return with_weekday(drop_undated(conform(parse_dates(raw))))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Incident CSV with a header, columns matched by name.

    Dates are read as text first, because a bad date must become null rather than fail the read.
    """
    known = {f.name: f.dataType for f in SCHEMA.fields}
    names = spark.read.csv(path, header=True, inferSchema=False).columns
    types = [
        T.StructField(name, T.StringType() if name in DATE_COLUMNS else known.get(name, T.StringType()))
        for name in names
    ]
    return load(spark.read.csv(path, schema=T.StructType(types), header=True, mode="PERMISSIVE"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return load(spark.read.parquet(path))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_prepared(df: DataFrame, path: str) -> None:
    """Prepared table for the reports, one folder per month so that date filters skip files.

    ``rebalance`` splits a busy month over several tasks and merges small ones, by their real sizes.
    """
    by_month = df.withColumn("incident_month", F.date_format("incident_date", "yyyy-MM"))
    by_month.hint("rebalance", F.col("incident_month")).write.mode("overwrite").partitionBy("incident_month").parquet(path)
