"""Investigation and completion rules, filters and option lists."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incidentry import fixed_values as fixed
from incidentry.functions.clock import delay_hours, is_prompt_time_frame, time_frame_hours, within
from incidentry.functions.common import strip
from incidentry.functions.wording import alert_message, alert_reason
from incidentry.operators.joins import keep_top, top_values


def truth(df: DataFrame, name: str, null_is_true: bool = True) -> Column:
    """Flag of any type as a truth value."""
    kind = df.schema[name].dataType
    value = F.col(name)
    if isinstance(kind, T.NumericType):
        value = value > 0
    elif isinstance(kind, T.StringType):
        value = F.when(value.isNotNull(), F.lower(strip(value)).isin(fixed.TRUE_WORDS))
    return F.coalesce(value, F.lit(null_is_true))


def _lower(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name), F.lit("")))


def with_investigation_rules(df: DataFrame, null_is_true: bool = True) -> DataFrame:
    """Add ``investigation_required`` and ``action_complete``. Run on raw severity, before it is normalised."""
    medical = truth(df, "medical_attention_required", null_is_true) | truth(df, "treatment_required", null_is_true)
    required = (
        (_lower("severity") == "high")
        | truth(df, "reportable", null_is_true)
        | strip(_lower("incident_type")).isin(fixed.SERIOUS_TYPES)
        | medical
    )
    complete = (
        (strip(_lower("medical_outcome")) == "recovered")
        | ((_lower("severity") == "low") & ~medical)
        | truth(df, "actions_documented", null_is_true)
    )
    return df.withColumns({"investigation_required": required, "action_complete": complete})


def with_stages(df: DataFrame, by_time_frame: bool | None = None) -> DataFrame:
    """Columns the stage report counts; the text time frame wins over the dates when the column is there."""
    if by_time_frame is None:
        by_time_frame = "notification_time_frame" in df.columns
    if by_time_frame:
        prompt = is_prompt_time_frame("notification_time_frame")
        hours = time_frame_hours("notification_time_frame").cast("double")
        late = ~prompt
    else:
        hours = delay_hours("incident_date", "notification_date")
        prompt = within(hours, 24)
        late = F.coalesce(hours > 24, F.lit(False))
    return df.withColumns(
        {
            "report_delay_hours": hours,
            "within_24h": prompt,
            "overdue_action": ~F.col("action_complete") & late,
            "under_investigation": F.col("investigation_required") & ~F.col("action_complete"),
        }
    )


def stage_condition(stage: str) -> Column:
    conditions = {
        "All_Incidents": lambda: F.lit(True),
        "Required_Investigation": lambda: F.col("investigation_required"),
        "Under_Investigation": lambda: F.col("under_investigation"),
        "Action_Complete": lambda: F.col("action_complete"),
        "Overdue_Actions": lambda: F.col("overdue_action"),
        "Compliance_Breach": lambda: ~F.col("within_24h"),
    }
    return conditions[stage]()


def incidents_in_stage(df: DataFrame, key: str, stage: str) -> DataFrame:
    """Rows of one stage, with the columns the table shows."""
    wanted = [key, "incident_id", "incident_date", "notification_time_frame", "report_delay_hours"]
    staged = with_stages(df).where(F.col(key).isNotNull() & stage_condition(stage))
    return staged.select(*[name for name in wanted if name in staged.columns])


def with_alerts(df: DataFrame) -> DataFrame:
    """Add ``alert_reason`` (null when no rule matches) and ``alert_message``."""
    reasoned = df.withColumn("alert_reason", alert_reason())
    return reasoned.withColumn("alert_message", F.when(F.col("alert_reason").isNotNull(), alert_message()))


@dataclass(frozen=True)
class IncidentFilter:
    """Side-bar filter; None means 'All'. ``end`` is a midnight unless ``inclusive_day`` is set."""

    start: str | None = None
    end: str | None = None
    inclusive_day: bool = False
    ages: tuple[int, int] | None = None
    location: str | None = None
    severity: str | None = None
    incident_type: str | None = None
    carer_id: str | None = None
    severities: tuple[str, ...] = ()
    incident_types: tuple[str, ...] = ()

    def condition(self) -> Column:
        parts = []
        if self.start is not None:
            parts.append(F.col("incident_date") >= F.lit(self.start).cast("timestamp_ntz"))
        if self.end is not None:
            end = F.lit(self.end).cast("timestamp_ntz")
            if self.inclusive_day:
                parts.append(F.col("incident_date") < end + F.expr("interval 1 day"))
            else:
                parts.append(F.col("incident_date") <= end)
        if self.ages is not None:
            parts.append(F.col("participant_age").between(*self.ages))
        for name in ("location", "severity", "incident_type", "carer_id"):
            if getattr(self, name) is not None:
                parts.append(F.col(name) == getattr(self, name))
        if self.severities:
            parts.append(F.col("severity").isin(list(self.severities)))
        if self.incident_types:
            parts.append(F.col("incident_type").isin(list(self.incident_types)))
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    def months(self) -> Column:
        """The same period in terms of the month folders of a stored prepared table."""
        parts = [F.lit(True)]
        if self.start is not None:
            parts.append(F.col("incident_month") >= self.start[:7])
        if self.end is not None:
            parts.append(F.col("incident_month") <= self.end[:7])
        return reduce(lambda a, b: a & b, parts)

    def apply(self, df: DataFrame) -> DataFrame:
        rows = df.where(self.condition())
        return rows.where(self.months()) if "incident_month" in df.columns else rows


def options(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values for a pick list."""
    return df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def bounds(df: DataFrame, *columns: str) -> DataFrame:
    return df.agg(*[f(name).alias(f"{label}_{name}") for name in columns for label, f in (("min", F.min), ("max", F.max))])


def busiest_carers(df: DataFrame, k: int = 20) -> DataFrame:
    return top_values(df, "carer_id", k, count="incidents")


def rows_of_busiest_carers(df: DataFrame, k: int = 20) -> DataFrame:
    return keep_top(df, busiest_carers(df, k), "carer_id")


def safe_cluster_columns(names: list[str]) -> list[str]:
    """Feature names a clustering may use: outcome-like columns are left out."""
    return [
        name
        for name in names
        if name not in fixed.CLUSTER_DROP_COLUMNS
        and not any(pattern in name.lower() for pattern in fixed.CLUSTER_DROP_PATTERNS)
    ]
