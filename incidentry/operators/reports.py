"""Counts and shares over the derived table.

Reports first count by the columns they need, which Spark does before the shuffle, and shape only those counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidentry import fixed_values as fixed
from incidentry.functions.clock import age_in_years, delay_days, hour_of_text, month_label, month_start
from incidentry.functions.common import beside, count_if
from incidentry.functions.wording import factor_label
from incidentry.operators.forecast import monthly_series
from incidentry.operators.joins import (
    dense,
    dense_within,
    fixed_table,
    number_domain,
    others_relabelled,
    severity_domain,
    top_values,
)
from incidentry.session import settle


def _rows(name: str = "count") -> Column:
    return F.count(F.lit(1)).alias(name)


def is_high(name: str = "severity") -> Column:
    return F.lower(name) == "high"


def trend(current: Column, previous: Column) -> tuple[Column, Column]:
    """Percent change without sign, and its direction."""
    change = F.when(previous == 0, 0.0).otherwise((current - previous) * 100.0 / F.nullif(previous, F.lit(0)))
    direction = F.when(change > 0, "up").when(change < 0, "down").otherwise("flat")
    return F.abs(change), direction


def executive_kpis(df: DataFrame) -> DataFrame:
    counts = settle(  # shaped three ways below: the rows are read once
        df.groupBy(month_start("incident_date").alias("month"), "incident_type").agg(
            _rows("n"), count_if(is_high()).alias("high"), F.sum("reportable_bin").alias("reported")
        )
    )
    top = top_values(counts, "incident_type", 1, F.col("n")).select(F.col("incident_type").alias("top_type"))
    whole = counts.agg(
        F.max("month").alias("latest"), F.sum("high").alias("high_severity"), F.sum("reported").alias("reportable")
    )
    months = counts.groupBy("month").agg(F.sum("n").alias("n"))
    latest = F.col("month") == F.col("latest")
    before = F.col("month") == F.add_months("latest", -1)
    return (
        beside(beside(months, whole), top)
        .groupBy("top_type", "latest", "high_severity", "reportable")
        .agg(
            F.coalesce(F.sum(F.when(latest, F.col("n"))), F.lit(0)).alias("latest_month_count"),
            F.coalesce(F.sum(F.when(before, F.col("n"))), F.lit(0)).alias("previous_month_count"),
        )
        .select(
            F.coalesce("top_type", F.lit("N/A")).alias("top_type"),
            F.date_format("latest", "MMMM yyyy").alias("latest_month"),
            "latest_month_count",
            F.date_format(F.add_months("latest", -1), "MMMM yyyy").alias("previous_month"),
            "previous_month_count",
            "high_severity",
            "reportable",
        )
    )


def side_panel(df: DataFrame, keep: Column) -> DataFrame:
    """Figures beside the filters: rows kept and in all, and for the kept ones days, places, types and shares."""
    keep = F.coalesce(keep, F.lit(False))
    counts = (
        df.withColumn("_kept", keep)
        .groupBy("_kept", "location", "incident_type")
        .agg(
            _rows("n"),
            F.min("incident_date").alias("first"),
            F.max("incident_date").alias("last"),
            count_if(F.col("severity_numeric") >= 3).alias("severe"),
            F.sum("reportable_bin").alias("reported"),
        )
    )
    kept = F.col("_kept")
    total = F.sum(F.when(kept, F.col("n")).otherwise(0))
    return counts.agg(
        total.alias("filtered_rows"),
        F.sum("n").alias("total_rows"),
        delay_days(F.min(F.when(kept, F.col("first"))), F.max(F.when(kept, F.col("last")))).alias("days"),
        F.count_distinct(F.when(kept, F.col("location"))).alias("locations"),
        F.count_distinct(F.when(kept, F.col("incident_type"))).alias("incident_types"),
        F.try_divide(F.sum(F.when(kept, F.col("severe"))) * 100.0, total).alias("high_severity_pct"),
        F.try_divide(F.sum(F.when(kept, F.col("reported"))) * 100.0, total).alias("reportable_pct"),
    )


def severity_distribution(df: DataFrame, zeros: bool = True) -> DataFrame:
    counts = df.groupBy("severity").agg(_rows())
    return dense(severity_domain(df.sparkSession), counts, ["severity"], ["count"]) if zeros else counts


def monthly_by_severity(df: DataFrame, zeros: bool = True) -> DataFrame:
    counts = df.groupBy(month_label("incident_date").alias("year_month"), "severity").agg(_rows())
    if not zeros:
        return counts
    names = F.array(*[F.lit(name) for name in fixed.SEVERITY_ORDER])
    return dense_within(counts, "year_month", "severity", names, "count")


def top_incident_types(df: DataFrame, k: int = 10) -> DataFrame:
    return top_values(df, "incident_type", k, count="count")


def top_locations(df: DataFrame, k: int = 8) -> DataFrame:
    return top_values(df, "location", k, count="count")


def daily_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.to_date("incident_date").alias("date")).agg(_rows("incidents"))


def weekday_counts(df: DataFrame) -> DataFrame:
    counts = df.groupBy("incident_weekday").agg(_rows())
    days = [(name, place) for place, name in enumerate(fixed.WEEKDAYS)]
    domain = fixed_table(df.sparkSession, days, "incident_weekday string, position int")
    return dense(domain, counts, ["incident_weekday"], ["count"])


def reportable_split(df: DataFrame) -> DataFrame:
    label = F.when(F.col("reportable_bin") == 1, "Reportable").otherwise("Not Reportable")
    return df.groupBy(label.alias("label")).agg(_rows())


def cause_column(df: DataFrame) -> str:
    """First cause column the table has."""
    return next(name for name in fixed.CAUSE_COLUMNS if name in df.columns)


def hour_by_cause(df: DataFrame, cause: str | None = None, k: int = 5) -> DataFrame:
    """Counts per hour and cause, the k most frequent causes by name and the rest as Other, on all 24 hours."""
    cause = cause or cause_column(df)
    counts = (
        df.withColumn("hour", hour_of_text("incident_time"))
        .where("hour is not null")
        .groupBy("hour", F.coalesce(F.col(cause), F.lit("Unknown")).alias("cause"))
        .agg(_rows("n"))
    )
    top = top_values(counts, "cause", k, F.col("n"), count="_n")
    grouped = (
        others_relabelled(counts, top, "cause", "cause_group").groupBy("hour", "cause_group").agg(F.sum("n").alias("count"))
    )
    filled = dense_within(grouped, "cause_group", "hour", F.sequence(F.lit(0), F.lit(23)), "count")
    return filled.withColumn("total", F.sum("count").over(Window.partitionBy("hour")))


def medical_outcomes(df: DataFrame) -> DataFrame:
    treated = F.coalesce("treatment_required", F.lit(False))
    medical = F.col("medical_attention_required_bin") == 1
    return df.agg(
        count_if(treated).alias("treatment_required"),
        count_if(medical).alias("medical_attention_required"),
        count_if(~(treated | medical)).alias("no_medical_intervention"),
    )


def reporter_metrics(df: DataFrame) -> DataFrame:
    counts = df.groupBy("reported_by").agg(
        F.sum("medical_attention_required_bin").alias("medical"),
        F.sum("participant_age").alias("ages"),
        F.count("participant_age").alias("aged"),
    )
    return counts.agg(
        F.count("reported_by").alias("reporter_types"),
        F.sum("medical").alias("medical_attention_required"),
        F.try_divide(F.sum("ages").cast("double"), F.sum("aged")).alias("avg_participant_age"),
    )


def operational_cards(df: DataFrame, as_of: str) -> DataFrame:
    rows = F.count(F.lit(1))
    return df.agg(
        F.avg(age_in_years("dob", as_of)).alias("avg_participant_age"),
        F.try_divide(F.sum("reportable_bin") * 100.0, rows).alias("reportable_rate"),
        F.try_divide(F.sum("medical_attention_required_bin") * 100.0, rows).alias("medical_attention_rate"),
        F.coalesce(F.sum("medical_attention_required_bin"), F.lit(0)).alias("medical_attention_required"),
    )


def severe_age_histogram(df: DataFrame, bins: int = 20) -> DataFrame:
    """Ages of high-severity incidents in equal-width bins between the youngest and the oldest; the last bin is closed."""
    ages = (
        df.where(is_high() & F.col("participant_age").isNotNull()).groupBy("participant_age").agg(_rows("n"))
    )
    ends = ages.agg(F.min("participant_age").alias("low"), F.max("participant_age").alias("high"))
    width = (F.col("high") - F.col("low")) / F.lit(float(bins))
    place = F.floor((F.col("participant_age") - F.col("low")) / F.nullif(width, F.lit(0.0))) + 1
    return (
        beside(ages, ends)
        .groupBy(F.coalesce(F.least(place, F.lit(bins)), F.lit(1)).cast("int").alias("bin"))
        .agg(
            F.first(F.col("low") * F.lit(1.0)).alias("_low"), F.first(width).alias("_width"), F.sum("n").alias("count")
        )
        .select("bin", (F.col("_low") + (F.col("bin") - 1) * F.col("_width")).alias("bin_start"), "count")
    )


def factors_by_month(df: DataFrame, k: int = 25) -> DataFrame:
    """Counts of the k most frequent factor labels on every month that occurs.

    Labels are made from counted factor texts, so the patterns run once per text and month rather than once per row.
    """
    texts = df.groupBy("contributing_factors", month_label("incident_date").alias("month")).agg(_rows("n"))
    labels = texts.groupBy(factor_label("contributing_factors").alias("factor"), "month").agg(F.sum("n").alias("n"))
    by_factor = labels.groupBy("factor").agg(
        F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("month", "n"))).alias("counts")
    )
    top = by_factor.orderBy(F.desc("total"), "factor").limit(k)
    all_kept = Window.partitionBy(F.lit(0))  # k rows at most
    months = F.array_distinct(F.flatten(F.collect_list(F.map_keys("counts")).over(all_kept)))
    return top.withColumn("month", months).select("factor", "counts", F.explode("month").alias("month")).select(
        "factor", "month", F.coalesce(F.try_element_at("counts", F.col("month")), F.lit(0)).alias("count")
    )


def monthly_counts(df: DataFrame, date: str = "incident_date") -> DataFrame:
    """Incidents per month, without gaps."""
    series = monthly_series(df, (), date).select("first_month", F.posexplode("y").alias("_place", "_n"))
    return series.select(F.add_months("first_month", F.col("_place")).alias("month"), F.col("_n").cast("bigint").alias("incidents"))


def monthly_trend(df: DataFrame, date: str = "incident_date") -> DataFrame:
    """Change from month to month; one row per month, so a single ordered window is small."""
    months = monthly_counts(df, date).withColumn("previous", F.lag("incidents").over(Window.orderBy("month")))
    change, direction = trend(F.col("incidents"), F.col("previous"))
    return months.withColumns({"change_pct": change, "direction": F.when(F.col("previous").isNotNull(), direction)})


def weekday_hour_matrix(df: DataFrame, date: str = "incident_datetime") -> DataFrame:
    """7 x 24 counts, one column per hour."""
    counts = (
        df.where(F.col(date).isNotNull())
        .groupBy(F.weekday(date).alias("day_of_week"), F.hour(date).alias("hour"))
        .agg(_rows("n"))
    )
    hours = counts.groupBy("day_of_week").pivot("hour", list(range(24))).agg(F.sum("n"))
    named = hours.select("day_of_week", *[F.col(str(h)).alias(f"h{h:02d}") for h in range(24)])
    names = [f"h{h:02d}" for h in range(24)]
    return dense(number_domain(df.sparkSession, "day_of_week", 7), named, ["day_of_week"], names)


def monthly_by_cause(df: DataFrame, by: str = "incident_type", date: str = "incident_datetime", k: int = 5) -> DataFrame:
    counts = (
        df.where(F.col(date).isNotNull())
        .groupBy(month_start(date).alias("month"), F.coalesce(F.col(by), F.lit("Unknown")).alias("value"))
        .agg(_rows("n"))
    )
    top = top_values(counts, "value", k, F.col("n"), count="_n")
    return others_relabelled(counts, top, "value", "category").groupBy("month", "category").agg(F.sum("n").alias("count"))


def largest_histories(df: DataFrame) -> DataFrame:
    """Most incidents of one participant and of one carer: bounds for the scenario form."""
    def most(key: str, name: str) -> DataFrame:
        counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("incident_id").alias("n"))
        return counts.agg(F.max("n").alias(name))

    return beside(most("participant_id", "max_participant_incidents"), most("carer_id", "max_carer_incidents"))


def locations_by_count(df: DataFrame) -> DataFrame:
    """Locations for the scenario form, most frequent first, with their mean severity (2.0 when unknown)."""
    return (
        df.where(F.col("location").isNotNull())
        .groupBy("location")
        .agg(_rows("incidents"), F.coalesce(F.avg("severity_numeric"), F.lit(2.0)).alias("location_risk"))
        .orderBy(F.desc("incidents"), "location")
    )
