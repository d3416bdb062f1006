"""From a raw incident table to the table the reports and models read.

``derive`` needs no shuffle, so reports that use no history can run on it directly; ``prepare`` adds the histories.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentry import fixed_values as fixed
from incidentry.functions.clock import combine_date_time, day_of_week, delay_hours, hour_of, within
from incidentry.functions.common import strip, title_case
from incidentry.functions.grades import normal_severity, severity_rank, with_flag
from incidentry.operators.history import with_histories, with_location_risk
from incidentry.operators.ordered import running_sums, time_buckets
from incidentry.operators.rules import with_investigation_rules
from incidentry.sources.incidents import load


def row_mark(names: list[str]) -> Column:
    """MD5 of the columns as texts: an order for rows of one date that no single column, constant or null, can spoil."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")) for name in names]))


def with_incident_ids(df: DataFrame) -> DataFrame:
    """Ids 1..n in date order when the table has none; ties by the mark of the other columns, then by these.

    No single task sorts the table or one day of it, and the ids do not depend on how the input was split. Rows alike in every column may
    trade ids.
    """
    if "incident_id" in df.columns:
        return df
    others = [name for name in df.columns if name != "incident_date"]
    counted = running_sums(
        df.withColumn("_mark", row_mark(others)),
        order=[F.col("incident_date"), F.col("_mark")] + [F.col(name).asc_nulls_last() for name in others],
        buckets=[time_buckets("incident_date", F.lit(0))[0], F.struct("incident_date", F.substring("_mark", 1, 4).alias("mark"))],
        sums={"_before": F.lit(1).cast("bigint")},
    )
    return counted.select((F.col("_before") + 1).alias("incident_id"), *df.columns)


def with_person_ids(df: DataFrame) -> DataFrame:
    """Participant and carer ids from the reporter when the column is absent."""
    reporter = F.regexp_replace(F.coalesce("reported_by", F.lit("unknown")), r"\s+", "_")
    made = F.concat_ws("_", reporter, F.col("incident_id").cast("string"))
    absent = [name for name in ("participant_id", "carer_id") if name not in df.columns]
    return df.withColumns({name: made for name in absent}) if absent else df


def with_datetime(df: DataFrame) -> DataFrame:
    """``incident_datetime``, kept when it is there already."""
    if "incident_datetime" in df.columns:
        return df
    if "incident_time" not in df.columns:
        return df.withColumn("incident_datetime", F.col("incident_date"))
    return df.withColumn("incident_datetime", combine_date_time("incident_date", "incident_time"))


def with_location(df: DataFrame) -> DataFrame:
    if "location" not in df.columns:
        return df.withColumn("location", F.lit("Unknown"))
    return df.withColumn("location", title_case(strip(F.coalesce("location", F.lit("Unknown")))))


def with_severity(df: DataFrame) -> DataFrame:
    return df.withColumn("severity", normal_severity("severity")).withColumn(
        "severity_numeric", severity_rank("severity")
    )


def with_calendar(df: DataFrame) -> DataFrame:
    weekend = F.when(F.col("day_of_week") >= 5, 1).otherwise(0)
    return (
        df.withColumns({"hour": hour_of("incident_datetime"), "day_of_week": day_of_week("incident_datetime")})
        .withColumn("is_weekend", weekend)
        .withColumn("day_type", F.when(F.col("is_weekend") == 1, "weekend").otherwise("weekday"))
    )


def with_rooms(df: DataFrame, bathroom: str = fixed.BATHROOM_PATTERN) -> DataFrame:
    place = F.lower("location")
    return df.withColumns(
        {
            "is_kitchen": F.when(place.rlike(fixed.KITCHEN_PATTERN), 1).otherwise(0),
            "is_bathroom": F.when(place.rlike(bathroom), 1).otherwise(0),
        }
    )


def with_delay(df: DataFrame, sla_hours: tuple[int, ...] = (24,)) -> DataFrame:
    """``report_delay_hours`` and one ``within_<n>h`` / ``over_<n>h`` pair per limit."""
    delayed = df.withColumn("report_delay_hours", delay_hours("incident_date", "notification_date"))
    hours = F.col("report_delay_hours")
    pairs = {}
    for limit in sla_hours:
        pairs[f"within_{limit}h"] = within(hours, limit)
        pairs[f"over_{limit}h"] = F.coalesce(hours > limit, F.lit(False))
    return delayed.withColumns(pairs)


def derive(df: DataFrame) -> DataFrame:
    """Row-wise part: rules on raw severity, then normalising and derived columns."""
    steps = [
        load,
        with_incident_ids,
        with_investigation_rules,
        with_datetime,
        with_severity,
        with_person_ids,
        with_location,
        lambda d: with_flag(d, "medical_attention_required", "medical_attention_required_bin"),
        lambda d: with_flag(d, "reportable", "reportable_bin"),
        with_calendar,
        with_rooms,
        with_delay,
    ]
    return reduce(lambda d, step: step(d), steps, df)


def prepare(df: DataFrame) -> DataFrame:
    """The full prepared table."""
    derived = derive(df)
    return with_location_risk(with_histories(derived), rated=derived)
