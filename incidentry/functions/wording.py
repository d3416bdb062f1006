"""Text made from incident columns: factor labels, summaries, recommendations, alert messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from incidentry import fixed_values as fixed
from incidentry.functions.common import as_column, pick, strip, title_case, whole_number

BEGINNING = 256


def factor_label(text: str | Column, mode: str = "full") -> Column:
    """Short label of a contributing factor; label aggregated rows rather than raw ones where you can."""
    text = as_column(text)
    if mode == "simple":
        first = F.split_part(text, F.lit(";"), F.lit(1))
        return F.coalesce(F.substring(F.when(first == "", text).otherwise(first), 1, 30), F.lit(""))
    # an array of one: its element is computed once, where a repeated expression would be computed for every rule
    return F.transform(F.array(F.lower(strip(text))), _label_of)[0]


def _first_words(low: Column) -> Column:
    """The first two words that are no stop words, out of the beginning of the text where it holds both as a whole."""
    token = fixed.FACTOR_TOKEN_PATTERN

    def kept(text: Column, pattern: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.slice(F.filter(found, lambda word: ~word.isin(fixed.FACTOR_STOP_WORDS)), 1, 2)

    early = kept(F.substring(low, 1, BEGINNING), rf"{token}(?=[^a-z0-9\-])")  # a word that the cut may have shortened is left out
    return F.when(F.size(early) == 2, early).otherwise(kept(low, token))


def _label_of(low: Column) -> Column:
    """The label of a text that is stripped and in lower case."""
    buckets = None
    for (pattern, label), stems in zip(fixed.FACTOR_PATTERNS, fixed.FACTOR_STEMS, strict=True):
        hit = reduce(lambda a, b: a | b, [low.contains(stem) for stem in stems]) & low.rlike(pattern)  # finding no stem is far cheaper
        buckets = F.when(hit, label) if buckets is None else buckets.when(hit, label)
    words = F.array_join(F.transform(_first_words(low), title_case), " ")
    return (
        F.when(low.isNull() | (low == ""), "Unknown")
        .otherwise(
            F.coalesce(
                pick(low, dict(fixed.FACTOR_PHRASES)),
                buckets,
                F.nullif(words, F.lit("")),
                F.lit("Other"),
            )
        )
    )


def _text(name: str, missing: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(missing))


def _date_text(name: str = "incident_date") -> Column:
    return F.coalesce(F.date_format(name, "yyyy-MM-dd"), F.lit(""))


def incident_summary(ruleset: str = "basic") -> Column:
    kind = title_case(strip(_text("incident_type", "incident")))
    delay = whole_number("notification_delay_days")
    carer = F.when(F.col("carer_id") != "", F.concat(F.lit("Carer "), F.col("carer_id"))).otherwise("Carer")
    return F.concat(
        F.lit("On "), _date_text(),
        F.lit(" at "), strip(_text("location", "Unknown")),
        F.lit(", a "), F.when(kind == "", "Incident").otherwise(kind),
        F.lit(" occurred (severity: "), strip(_text("severity", "Unknown")), F.lit(")"),
        F.when(delay.isNotNull(), F.concat(F.lit(", notified after "), delay, F.lit(" day(s)"))).otherwise(""),
        F.lit(". "), carer, F.lit(fixed.SUMMARY_CLOSING[ruleset]),
    )


def is_self_harm(kind: Column) -> Column:
    return kind.contains("self") | kind.contains("harm")


def mitigations(ruleset: str = "basic") -> Column:
    """Ordered recommendations of the rules that fire; a default line when none does."""
    lines = fixed.MITIGATIONS[ruleset]
    severity = F.lower(_text("severity", ""))
    kind = F.lower(_text("incident_type", ""))
    severe = severity.isin(fixed.ALERT_SEVERITIES)
    if ruleset == "extended":
        reported = F.coalesce(whole_number("reportable_bin"), F.lit(0)) == 1
        severe = severe | (reported & severity.isin(fixed.ALERT_MODERATE))
    fired = F.filter(
        F.array(
            F.when(whole_number("notification_delay_days") > 1, lines["late"]),
            F.when(is_self_harm(kind), lines["self_harm"]),
            F.when(kind.contains("medication"), lines["medication"]),
            F.when(kind.contains("fall"), lines["fall"]),
            F.when(severe, lines["severe"]),
        ),
        lambda line: line.isNotNull(),
    )
    return F.when(F.size(fired) == 0, F.array(F.lit(lines["default"]))).otherwise(F.array_distinct(fired))


def prompt(context: list[str], narrative: str | Column = "narrative") -> Column:
    """Text handed to a caller's text model."""
    return F.concat(
        F.lit(fixed.PROMPT_HEAD), F.coalesce(as_column(narrative), F.lit("")),
        F.lit(fixed.PROMPT_CONTEXT), F.to_json(F.struct(*context)),
        F.lit(fixed.PROMPT_TASKS),
    )


def alert_reason() -> Column:
    """First alert rule that matches; null when none does."""
    severity = F.lower(_text("severity", ""))
    kind = F.lower(_text("incident_type", ""))
    return (
        F.when(severity.isin(fixed.ALERT_SEVERITIES), "high_severity")
        .when(is_self_harm(kind), "self_harm_risk")
        .when(F.col("notification_delay_days") > 1, "late_notification")
        .when((F.col("reportable_bin") == 1) & severity.isin(fixed.ALERT_MODERATE), "reportable_moderate")
    )


def alert_message(reason: str | Column = "alert_reason") -> Column:
    return F.format_string(
        fixed.ALERT_MESSAGE,
        _text("incident_id", "unknown"), as_column(reason), _text("severity", "NA"), _text("location", "NA"), _date_text(),
    )


def recommendation(scenario: str | Column) -> Column:
    name = as_column(scenario)
    chain = None
    for known, lines in fixed.SCENARIO_RECOMMENDATIONS.items():
        value = F.array(*[F.lit(line) for line in lines])
        chain = F.when(name == known, value) if chain is None else chain.when(name == known, value)
    return chain.otherwise(F.array(*[F.lit(line) for line in fixed.DEFAULT_RECOMMENDATION]))
