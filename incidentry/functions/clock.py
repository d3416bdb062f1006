"""Dates, times and delays. Incident times are TIMESTAMP_NTZ; the session runs in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from incidentry import fixed_values as fixed
from incidentry.functions.common import as_column, pick

MICROS_PER_HOUR = 3_600_000_000
MICROS_PER_DAY = 24 * MICROS_PER_HOUR


def micros(value: str | Column) -> Column:
    return F.unix_micros(as_column(value).cast("timestamp"))


def combine_date_time(date: str | Column, time: str | Column) -> Column:
    """Date part plus time text; the plain date where the text does not parse."""
    date, time = as_column(date), as_column(time)
    text = F.concat_ws(" ", F.date_format(date, "yyyy-MM-dd"), time)
    return F.when(time.isNotNull(), F.coalesce(text.try_cast("timestamp_ntz"), date)).otherwise(date)


def delay_hours(start: str | Column, end: str | Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(float(MICROS_PER_HOUR))


def delay_days(start: str | Column, end: str | Column) -> Column:
    """Whole elapsed days, rounded down; not a count of midnights."""
    return F.floor((micros(end) - micros(start)) / F.lit(float(MICROS_PER_DAY))).cast("int")


def within(hours: Column, limit: float) -> Column:
    """An unknown delay is not compliant."""
    return F.coalesce(hours <= limit, F.lit(False))


def month_start(value: str | Column) -> Column:
    return F.date_trunc("month", as_column(value)).cast("date")


def month_label(value: str | Column) -> Column:
    return F.date_format(as_column(value), "yyyy-MM")


def day_name(value: str | Column) -> Column:
    return F.date_format(as_column(value), "EEEE")


def hour_of(value: str | Column, default: int | None = 12) -> Column:
    hour = F.hour(as_column(value))
    return hour if default is None else F.coalesce(hour, F.lit(default))


def day_of_week(value: str | Column) -> Column:
    """0 is Monday."""
    return F.coalesce(F.weekday(as_column(value)), F.lit(0))


def hour_of_text(value: str | Column) -> Column:
    """Hour of a clock time given as text."""
    text = F.concat_ws(" ", F.lit("1970-01-01"), as_column(value))
    return F.when(as_column(value).isNotNull(), F.hour(text.try_cast("timestamp_ntz")))


def time_frame_hours(value: str | Column) -> Column:
    return pick(as_column(value), fixed.TIME_FRAME_HOURS, fixed.TIME_FRAME_DEFAULT_HOURS)


def is_prompt_time_frame(value: str | Column) -> Column:
    return F.coalesce(F.lower(as_column(value)).rlike(fixed.PROMPT_TIME_FRAME_PATTERN), F.lit(False))


def age_in_years(birth: str | Column, as_of: str | Column) -> Column:
    return F.floor(F.datediff(F.to_date(as_of) if isinstance(as_of, Column) else F.lit(as_of).cast("date"),
                              as_column(birth).cast("date")) / 365).cast("int")


def age_range(age: str | Column) -> Column:
    age = as_column(age)
    return (
        F.when(age.isNull(), "Unknown")
        .when(age < 18, "Under 18")
        .when(age < 30, "18-29")
        .when(age < 45, "30-44")
        .when(age < 60, "45-59")
        .otherwise("60+")
    )
