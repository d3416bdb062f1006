"""Carer and compliance reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentry import fixed_values as fixed
from incidentry.functions.clock import delay_days
from incidentry.functions.common import beside, count_if, share
from incidentry.functions.grades import compliance_band, delay_band, plain_flag, severity_rank, workload_band
from incidentry.operators.joins import dense, severity_domain
from incidentry.operators.ordered import exact_percentiles
from incidentry.session import settle
from incidentry.operators.reports import is_high
from incidentry.operators.rules import stage_condition, with_stages

WORKLOAD_FOCUS = {
    "all": None,
    "high_volume": lambda: F.col("incidents_per_month") >= 8,
    "problem_correlation": lambda: F.col("avg_delay") > 2,
    "efficiency": lambda: (F.col("incidents_per_month") >= 5) & (F.col("avg_delay") <= 2),
}
COMPLIANCE_FOCUS = {"all": None, "below_95": 95, "below_85": 85, "below_70": 70}
DELAY_FOCUS = {"all": None, "over_1": 1, "over_2": 2, "over_3": 3}


def carer_workload(df: DataFrame, min_incidents: int = 1, focus: str = "all") -> DataFrame:
    """Delay, volume and risk per carer over incidents whose both dates are known."""
    dated = df.where(
        F.col("carer_id").isNotNull() & F.col("incident_date").isNotNull() & F.col("notification_date").isNotNull()
    )
    carers = dated.groupBy("carer_id").agg(
        F.avg(delay_days("incident_date", "notification_date")).alias("avg_delay"),
        F.count("incident_date").alias("total_incidents"),
        count_if(is_high()).alias("high_severity_count"),
        F.sum("reportable_bin").alias("reportable_count"),
        F.min("incident_date").alias("first_incident"),
        F.max("incident_date").alias("last_incident"),
    )
    total = F.col("total_incidents")
    carers = (
        carers.withColumn("date_range", delay_days("first_incident", "last_incident"))
        .withColumn(
            "incidents_per_month",
            F.when(F.col("date_range") > 0, total / (F.col("date_range") / F.lit(30.44))).otherwise(total.cast("double")),
        )
        .withColumn(
            "risk_score",
            F.col("avg_delay") * 0.4
            + (F.col("high_severity_count") / total * 10) * 0.3
            + (F.col("reportable_count") / total * 10) * 0.3,
        )
        .withColumn("workload_category", workload_band("incidents_per_month"))
        .where(total >= min_incidents)
    )
    rule = WORKLOAD_FOCUS[focus]
    return carers if rule is None else carers.where(rule())


def workload_summary(carers: DataFrame) -> DataFrame:
    busy = F.col("incidents_per_month") >= 10
    many = F.count(F.lit(1)) > 1
    delay = F.avg("avg_delay")
    return carers.agg(
        count_if(busy & (F.col("avg_delay") <= 2)).alias("efficient_high_volume"),
        count_if(busy & (F.col("avg_delay") > 2)).alias("overwhelmed_high_volume"),
        F.when(many, F.corr("avg_delay", F.col("total_incidents").cast("double"))).otherwise(0.0).alias("correlation"),
        F.when(delay > 0, F.avg("incidents_per_month") / F.nullif(delay, F.lit(0.0))).otherwise(0.0).alias("efficiency"),
    )


def workload_lists(carers: DataFrame) -> DataFrame:
    """Busy carers who report fast, and those who do not."""
    busy = F.col("incidents_per_month") >= 8
    group = F.when(busy & (F.col("avg_delay") <= 1.5), "high_performer").when(busy & (F.col("avg_delay") > 3), "overloaded")
    return (
        carers.withColumn("group", group)
        .where("group is not null")
        .select(
            "group",
            "carer_id",
            F.bround("incidents_per_month", 1).alias("incidents_per_month"),
            F.bround("avg_delay", 1).alias("avg_delay"),
            "total_incidents",
        )
    )


def workload_trend_line(carers: DataFrame) -> DataFrame:
    """Straight line of incidents over delay, for more than three carers."""
    total = F.col("total_incidents").cast("double")
    return carers.agg(
        F.regr_slope(total, F.col("avg_delay")).alias("slope"),
        F.regr_intercept(total, F.col("avg_delay")).alias("intercept"),
        F.min("avg_delay").alias("from_delay"),
        F.max("avg_delay").alias("to_delay"),
        F.count(F.lit(1)).alias("carers"),
    ).where("carers > 3")


def medical_share(df: DataFrame) -> Column:
    """Mean of the text variant of the medical flag."""
    return F.avg(plain_flag("medical_attention_required"))


def rank_or_two(df: DataFrame) -> Column:
    return F.col("severity_numeric") if "severity_numeric" in df.columns else severity_rank("severity", 2)


def carer_profile(df: DataFrame) -> DataFrame:
    """Volume, severe share and medical share per carer, with the 80th percentiles of the first two over all carers."""
    carers = settle(  # read for the percentiles, too
        df.where("carer_id is not null")
        .groupBy("carer_id")
        .agg(
            F.count("incident_id").alias("incidents"),
            share(rank_or_two(df) >= 3).alias("high_crit"),
            medical_share(df).alias("med_rate"),
        )
    )
    lines = exact_percentiles(carers, {"high_crit_p80": ("high_crit", 0.8), "incidents_p80": ("incidents", 0.8)})
    return beside(carers, lines)


def risk_profile(df: DataFrame, key: str = "incident_type") -> DataFrame:
    """Volume, severe share and medical share per type or location, largest first."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.count("incident_id").alias("incidents"),
            share(rank_or_two(df) >= 3).alias("high_crit_rate"),
            medical_share(df).alias("medical_rate"),
        )
        .orderBy(F.desc("incidents"), key)
    )


def compliance_kpis(df: DataFrame) -> DataFrame:
    rows = F.count(F.lit(1))
    required = count_if(F.col("investigation_required"))
    complete = count_if(F.col("action_complete"))
    return df.agg(
        F.sum("reportable_bin").alias("reportable"),
        count_if(F.col("within_24h")).alias("within_24h"),
        F.try_divide(count_if(F.col("within_24h")) * 100.0, rows).alias("within_24h_pct"),
        count_if(F.col("over_24h")).alias("overdue"),
        F.try_divide(required * 100.0, rows).alias("investigation_rate"),
        required.alias("investigation_required"),
        complete.alias("action_complete"),
        F.when(required > 0, complete * 100.0 / F.nullif(required, F.lit(0))).otherwise(0.0).alias("investigation_status_pct"),
        count_if(F.col("over_24h")).alias("compliance_breach"),
    )


def compliance_by_carer(df: DataFrame) -> DataFrame:
    """Share of incidents reported within 24 hours per carer; unknown delays count as late."""
    return (
        df.where("carer_id is not null")
        .groupBy("carer_id")
        .agg(
            (share(F.col("within_24h")) * 100).alias("compliance_rate"),
            F.count(F.lit(1)).alias("incident_count"),
            count_if(is_high()).alias("high_severity_count"),
            F.sum("reportable_bin").alias("reportable_count"),
        )
        .withColumn("category", compliance_band("compliance_rate"))
    )


def worst_compliance(carers: DataFrame, min_incidents: int = 3, focus: str = "below_95", limit: int = 25) -> DataFrame:
    kept = carers.where(F.col("incident_count") >= min_incidents)
    if COMPLIANCE_FOCUS[focus] is not None:
        kept = kept.where(F.col("compliance_rate") < COMPLIANCE_FOCUS[focus])
    return kept.orderBy("compliance_rate", "carer_id").limit(limit)


def compliance_summary(shown: DataFrame) -> DataFrame:
    return shown.agg(
        count_if(F.col("compliance_rate") < 85).alias("below_85"),
        count_if(F.col("compliance_rate") < 70).alias("below_70"),
        F.avg("compliance_rate").alias("average_rate"),
        F.sum("incident_count").alias("total_incidents"),
    )


def delay_by_carer(df: DataFrame) -> DataFrame:
    """Whole-day delays per carer.

    Rows are counted by carer and delay first; the median then reads a handful of weighted values per carer.
    """
    counts = (
        df.where("carer_id is not null")
        .groupBy("carer_id", delay_days("incident_date", "notification_date").alias("days"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    known = F.when(F.col("days").isNotNull(), F.col("n")).otherwise(0)
    return (
        counts.groupBy("carer_id")
        .agg(
            F.try_divide(F.sum(F.col("days") * F.col("n")).cast("double"), F.sum(known)).alias("avg_delay"),
            F.sum(known).alias("incident_count"),
            F.percentile("days", 0.5, F.col("n")).alias("median_delay"),
            F.max("days").alias("max_delay"),
        )
        .withColumn("band", delay_band("avg_delay"))
    )


def worst_delay(carers: DataFrame, min_incidents: int = 4, focus: str = "all", limit: int = 40) -> DataFrame:
    kept = carers.where(F.col("incident_count") >= min_incidents)
    if DELAY_FOCUS[focus] is not None:
        kept = kept.where(F.col("avg_delay") > DELAY_FOCUS[focus])
    return kept.orderBy(F.desc("avg_delay"), "carer_id").limit(limit)


def delay_summary(shown: DataFrame) -> DataFrame:
    return shown.agg(
        count_if(F.col("avg_delay") <= 1).alias("excellent"),
        count_if(F.col("avg_delay") > 2).alias("needs_attention"),
        count_if(F.col("avg_delay") > 3).alias("poor"),
        F.avg("avg_delay").alias("average_delay"),
    )


def delay_by_date(df: DataFrame) -> DataFrame:
    return (
        df.where("report_delay_hours is not null")
        .groupBy(F.to_date("incident_date").alias("incident_date"))
        .agg(F.avg("report_delay_hours").alias("report_delay_hours"))
    )


def stage_counts(df: DataFrame, key: str = "carer_id", by_time_frame: bool | None = None, zeros: bool = True) -> DataFrame:
    """Investigation stages per key, one column per stage."""
    counts = (
        with_stages(df, by_time_frame)
        .where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(*[count_if(stage_condition(stage)).alias(stage) for stage in fixed.STAGES])
    )
    if key == "severity" and zeros:
        return dense(severity_domain(df.sparkSession), counts, ["severity"], fixed.STAGES)
    return counts


def stages_long(counts: DataFrame, key: str) -> DataFrame:
    return counts.unpivot(key, fixed.STAGES, "stage", "count")


def risk_network(df: DataFrame) -> DataFrame:
    """Carer-participant pairs; the means are rounded to three digits before the score is built."""
    pairs = settle(  # the largest count, the score and its percentile are read from the counted pairs
        df.where("carer_id is not null and participant_id is not null")
        .groupBy("carer_id", "participant_id")
        .agg(
            F.count("incident_id").alias("incident_count"),
            F.bround(F.avg(rank_or_two(df)), 3).alias("avg_severity"),
            F.bround(medical_share(df), 3).alias("medical_rate"),
        )
    )
    most = pairs.agg(F.greatest(F.max("incident_count"), F.lit(1)).alias("_most"))
    return (
        beside(pairs, most)
        .withColumn(
            "risk_score",
            F.col("avg_severity") * 0.4
            + F.col("medical_rate") * 0.3
            + (F.col("incident_count") / F.col("_most")) * 0.3,
        )
        .drop("_most")
    )


def high_risk_pairs(pairs: DataFrame, portion: float = 0.8) -> DataFrame:
    """Pairs above the percentile of the score, riskiest first."""
    cut = exact_percentiles(pairs, {"_cut": ("risk_score", portion)})
    return (
        beside(pairs, cut)
        .where(F.col("risk_score") > F.col("_cut"))
        .drop("_cut")
        .orderBy(F.desc("risk_score"), "carer_id", "participant_id")
    )
