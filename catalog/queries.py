"""One entry per operator: ``name -> f(spark, folder)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.tables import (
    AS_OF,
    delayed,
    derived,
    embedding_columns,
    events,
    plain,
    prepared,
    raw,
    scored,
)
from incidentry import fixed_values as fixed
from incidentry.functions import clock, common, grades, places, wording
from incidentry.models import calibration, classifiers, scenarios, splits
from incidentry.models.features import feature_frame, one_hot
from incidentry.models.guard import LeakageGuard
from incidentry.operators import (
    carers,
    clustering,
    correlation,
    decomposition,
    evaluation,
    forecast,
    gate,
    geography,
    history,
    joins,
    journeys,
    narrative_search,
    narratives,
    ordered,
    reports,
    rules,
    similarity,
)
from incidentry.plans import prepare
from incidentry.session import drop_scratch, scratch_path, settle
from incidentry.sources import incidents as source
from incidentry.streaming import alerts

QUERIES = {}
GUARD_CANDIDATES = [
    "hour", "is_weekend", "is_kitchen", "participant_age", "report_delay_hours", "incident_id", "severity_numeric", "label_copy",
]
CORRELATED = ["participant_age", "severity_numeric", "reportable_bin", "hour", "report_delay_hours"]
LAST_DAY = "1997-12-31"


def register(name: str):
    def keep(build):
        QUERIES[name] = lambda spark, folder: plain(build(spark, folder))
        return build

    return keep


def on(name: str, table, build) -> None:
    """Register a query that is one expression over one input table."""
    QUERIES[name] = lambda spark, folder: plain(build(table(spark, folder)))


# --- sources and sinks -------------------------------------------------------------------------------------------------
@register("s1_read_csv")
def s1(spark, folder):
    path = scratch_path(spark, "incidents-csv")
    source.write_csv(raw(spark, folder), path)
    return source.read_csv(spark, path).select(
        "incident_id", "incident_date", "incident_time", "notification_date", "severity", "location", "reportable",
        "participant_age", "dob", "latitude", "incident_weekday",
    )


on("s2_drop_undated", raw, lambda d: source.drop_undated(
    d.withColumn("incident_date", F.col("notification_date"))  # a date column with nulls
).select("incident_id", "incident_date"))
on("s3_weekday", raw, lambda d: source.load(d).select("incident_id", "incident_weekday"))
on("s4_surrogate_ids", raw, lambda d: prepare.with_incident_ids(
    d.select("incident_date", "incident_time", "participant_id", "carer_id", "incident_type")
))


@register("s5_geocoded_csv")
def s5(spark, folder):
    path = scratch_path(spark, "geocoded-csv")
    table = geography.with_place_points(derived(spark, folder)).select("incident_id", "location", "lat", "lon")
    source.write_csv(table, path)
    return spark.read.csv(path, header=True, schema="incident_id bigint, location string, lat double, lon double")


@register("s5_prepared_by_month")
def s5_month(spark, folder):
    path = scratch_path(spark, "prepared")
    source.write_prepared(derived(spark, folder), path)
    return spark.read.parquet(path).groupBy("incident_month").agg(F.count(F.lit(1)).alias("count"))


# --- normalising and deriving ------------------------------------------------------------------------------------------
@register("n1_flags")
def n1(spark, folder):
    flagged = raw(spark, folder)
    for name, target in (("reportable", "from_boolean"), ("participant_age", "from_number"),
                         ("medical_text", "from_words"), ("reportable_text", "from_number_text")):
        flagged = grades.with_flag(flagged, name, target)
    return flagged.select("incident_id", "from_boolean", "from_number", "from_words", "from_number_text")


on("n2_severity", raw, lambda d: d.select("incident_id", grades.normal_severity("severity").alias("severity")))
on("n3_severity_rank", raw, lambda d: d.select(
    "incident_id",
    grades.severity_rank(grades.normal_severity("severity")).alias("severity_numeric"),
    grades.severity_rank(common.title_case(F.trim("severity")), 2).alias("variant"),
))
on("n4_datetime", raw, lambda d: d.select(
    "incident_id", clock.combine_date_time("incident_date", "incident_time").alias("incident_datetime")
))
on("n5_ensure_datetime", raw, lambda d: prepare.with_datetime(prepare.with_datetime(d)).select("incident_id", "incident_datetime"))
on("n6_person_ids", raw, lambda d: prepare.with_person_ids(d.drop("participant_id", "carer_id")).select(
    "incident_id", "participant_id", "carer_id"
))
on("n7_location", raw, lambda d: prepare.with_location(d).select("incident_id", "location"))
on("n8_flag_columns", derived, lambda d: d.select(
    "incident_id", "medical_attention_required_bin", "reportable_bin",
    grades.plain_flag("medical_text").alias("medical_plain"), grades.plain_flag("reportable_text").alias("reportable_plain"),
))
on("n9_calendar", derived, lambda d: d.select("incident_id", "hour", "day_of_week", "is_weekend", "day_type"))
on("n10_rooms", derived, lambda d: d.select(
    "incident_id", "is_kitchen", "is_bathroom",
    F.when(F.lower("location").rlike(fixed.BATHROOM_PATTERN_FALLBACK), 1).otherwise(0).alias("is_bathroom_fallback"),
))
on("n11_delay_hours", derived, lambda d: prepare.with_delay(d, (24, 120)).select(
    "incident_id", "report_delay_hours", "within_24h", "over_24h", "within_120h", "over_120h"
))
on("n12_delay_days", raw, lambda d: d.select(
    "incident_id", clock.delay_days("incident_date", "notification_date").alias("delay_days")
))
on("n13_time_frame", raw, lambda d: d.select(
    "incident_id", clock.time_frame_hours("notification_time_frame").alias("hours"),
    clock.is_prompt_time_frame("notification_time_frame").alias("within_24h"),
))
on("n14_age", raw, lambda d: d.select(
    "incident_id", clock.age_in_years("dob", AS_OF).alias("age"),
    clock.age_range(clock.age_in_years("dob", AS_OF)).alias("age_range"),
))
on("n15_map_severity", raw, lambda d: d.select(
    "incident_id", grades.map_severity(F.trim("severity")).alias("category"),
    grades.map_severity_rank(grades.map_severity(F.trim("severity"))).alias("rank"),
))
on("n16_cause", raw, lambda d: d.drop("incident_type").groupBy(
    F.coalesce(reports.cause_column(d.drop("incident_type")), F.lit("Unknown")).alias("cause")
).agg(F.count(F.lit(1)).alias("count")))
on("n17_numeric_frame", raw, lambda d: clustering.numeric_frame(d, "incident_id"))
on("n18_feature_labels", raw, lambda d: d.select(
    common.clean_label(F.concat(F.lit("type__"), F.lower("incident_type"))).alias("label")
).distinct())
on("n19_month_label", raw, lambda d: d.select("incident_id", clock.month_label("incident_date").alias("month")))

# --- filters and rules -------------------------------------------------------------------------------------------------
on("f1_date_range", derived, lambda d: rules.IncidentFilter(start="1996-01-01", end=LAST_DAY).apply(d).select(
    "incident_id", "incident_date"
))
on("f2_age_range", derived, lambda d: rules.IncidentFilter(ages=(20, 45)).apply(d).select("incident_id", "participant_age"))
on("f3_equality", derived, lambda d: rules.IncidentFilter(
    location="Bathroom", severity="High", incident_type="Fall", start="1995-01-01"
).apply(d).select("incident_id", "location", "severity", "carer_id"))
on("f4_map_filter", derived, lambda d: rules.IncidentFilter(
    start="1996-01-01", end=LAST_DAY, severities=("High", "Critical"), incident_types=("Fall", "Assault")
).apply(d).select("incident_id", "severity", "incident_type"))
on("f5_options", derived, lambda d: rules.options(d, "location"))
on("f5_bounds", derived, lambda d: rules.bounds(d, "incident_date", "participant_age"))
on("f6_f7_investigation", derived, lambda d: d.select("incident_id", "investigation_required", "action_complete"))
on("f8_alert_policy", delayed, lambda d: d.select("incident_id", wording.alert_reason().alias("alert_reason")))
on("f8_alert_policy_raw_severity", delayed, lambda d: d.drop("severity").withColumn(
    "severity", F.when(F.col("incident_id") % 2 == 0, "moderate").otherwise(F.col("hour").cast("string"))
).groupBy(wording.alert_reason().alias("alert_reason")).agg(F.count(F.lit(1)).alias("count")))
on("f9_addresses", raw, lambda d: d.select(
    "incident_id", places.looks_like_address("address").alias("is_address"),
    places.looks_like_street(F.regexp_replace("address", ", (?i)nsw", " NSW")).alias("is_street"),
))
on("f10_focus", derived, lambda d: carers.carer_workload(d, 3, "problem_correlation").select("carer_id", "avg_delay")
   .withColumn("focus", F.lit("delay"))
   .unionByName(carers.carer_workload(d, 3, "high_volume").select("carer_id", "avg_delay").withColumn("focus", F.lit("volume")))
   .unionByName(carers.carer_workload(d, 3, "efficiency").select("carer_id", "avg_delay").withColumn("focus", F.lit("efficiency"))))
on("f11_busiest_carers", derived, lambda d: rules.rows_of_busiest_carers(d).groupBy("carer_id").agg(
    F.count(F.lit(1)).alias("incidents")
))
on("f12_stage_rows", derived, lambda d: rules.incidents_in_stage(d, "carer_id", "Under_Investigation"))
on("f13_safe_columns", derived, lambda d: clustering.numeric_frame(
    d, "incident_id", rules.safe_cluster_columns([n for n in common.numeric_columns(d) if n != "incident_id"])
))
on("f14_bands", derived, lambda d: d.groupBy(
    grades.workload_band(F.col("report_delay_hours") / 10).alias("workload"),
    grades.compliance_band(F.col("participant_age") + 15).alias("compliance"),
    grades.delay_band(F.col("report_delay_hours") / 24).alias("delay"),
    grades.risk_level(F.col("participant_age") / 100).alias("risk"),
).agg(F.count(F.lit(1)).alias("count")))
on("f15_high_risk_pairs", derived, lambda d: carers.high_risk_pairs(carers.risk_network(d)))

# --- joins -------------------------------------------------------------------------------------------------------------
on("j1_location_risk", derived, lambda d: history.with_location_risk(d).select("incident_id", "location", "location_risk_score"))
on("j2_geocoded_lookup", derived, lambda d: geography.with_geocoded(
    d.select("incident_id", "location"),
    d.where("latitude is not null and longitude is not null").select(
        "location", F.col("latitude").alias("lat"), F.col("longitude").alias("lon")
    ),
))
on("j3_suburb_centroid", raw, lambda d: d.select("incident_id", places.suburb("address").alias("suburb")).join(
    F.broadcast(geography.centroids(d.sparkSession)), "suburb", "left"
))
on("j4_keyword_centroid", raw, lambda d: d.select(
    "incident_id",
    geography.keyword_point("address")[0].alias("lat"),
    geography.keyword_point("address")[1].alias("lon"),
))
on("j5_actual_and_forecast", raw, lambda d: forecast.forecast(d, 8, ["participant_id"]))
on("j6_dense_hours", derived, lambda d: joins.dense(
    joins.number_domain(d.sparkSession, "hour", 24),
    d.groupBy("hour").agg(F.count(F.lit(1)).alias("count")),
    ["hour"], ["count"],
))
on("j7_top_types_or_other", derived, lambda d: joins.others_relabelled(
    d.select("incident_id", "incident_type"), joins.top_values(d, "incident_type", 3), "incident_type", "category"
).groupBy("category").agg(F.count(F.lit(1)).alias("count")))


@register("j9_feature_columns")
def j9(spark, folder):
    """Base columns, and the names of the one-hot columns that are 1 in the row, with the number of all of them."""
    features = feature_frame(prepared(spark, folder), names_from=derived(spark, folder))
    hot = [name for name in features.names if "__" in name]
    marked = F.array_compact(F.array(*[F.when(F.col(f"`{name}`") == 1.0, F.lit(name)) for name in sorted(hot)]))
    zeros = F.aggregate(F.array(*[F.col(f"`{name}`") for name in hot]), F.lit(0), lambda n, v: n + (v == 0.0).cast("int"))
    base = [name for name in features.names if name not in hot]
    return features.frame.select("incident_id", *base, marked.alias("hot"), zeros.alias("zeros"))


# --- reports -----------------------------------------------------------------------------------------------------------
on("a1_executive_kpis", derived, reports.executive_kpis)
on("a2_side_panel", derived, lambda d: reports.side_panel(
    d, rules.IncidentFilter(start="1996-01-01", end=LAST_DAY, ages=(20, 60)).condition()
))
on("a3_severity_distribution", derived, reports.severity_distribution)
on("a4_monthly_by_severity", derived, reports.monthly_by_severity)
on("a5_top_types", derived, reports.top_incident_types)
on("a5_top_locations", derived, reports.top_locations)
on("a6_daily", derived, reports.daily_counts)
on("a6_weekday", derived, reports.weekday_counts)
on("a6_reportable", derived, reports.reportable_split)
on("a7_hour_by_cause", derived, reports.hour_by_cause)
on("a8_medical_outcomes", derived, reports.medical_outcomes)
on("a8_reporter_metrics", derived, reports.reporter_metrics)
on("a8_operational_cards", derived, lambda d: reports.operational_cards(d, AS_OF))
on("a9_carer_workload", derived, carers.carer_workload)
on("a9b_workload_summary", derived, lambda d: carers.workload_summary(carers.carer_workload(d, 3)))
on("a9b_workload_lists", derived, lambda d: carers.workload_lists(carers.carer_workload(d, 3)))
on("a9c_trend_line", derived, lambda d: carers.workload_trend_line(carers.carer_workload(d, 3)))
on("a10_carer_profile", derived, carers.carer_profile)
on("a11_severe_ages", derived, reports.severe_age_histogram)
on("a12_compliance_kpis", derived, carers.compliance_kpis)
on("a13_compliance_by_carer", derived, lambda d: carers.worst_compliance(carers.compliance_by_carer(d)))
on("a13_compliance_all_carers", derived, carers.compliance_by_carer)
on("a13_compliance_summary", derived, lambda d: carers.compliance_summary(carers.worst_compliance(carers.compliance_by_carer(d))))
on("a14_delay_by_carer", derived, lambda d: carers.worst_delay(carers.delay_by_carer(d)))
on("a14_delay_summary", derived, lambda d: carers.delay_summary(carers.worst_delay(carers.delay_by_carer(d))))
on("a15_delay_by_date", derived, carers.delay_by_date)
on("a16_stages_by_carer", derived, carers.stage_counts)
on("a16_stages_by_severity", derived, lambda d: carers.stage_counts(d, "severity"))
on("a16_stages_by_dates", derived, lambda d: carers.stage_counts(d, "incident_type", by_time_frame=False))
on("v2_stages_long", derived, lambda d: carers.stages_long(carers.stage_counts(d, "location"), "location"))
on("a17_factors_by_month", derived, reports.factors_by_month)
on("a18_monthly_counts", derived, reports.monthly_counts)
on("a19_weekday_hour", derived, reports.weekday_hour_matrix)
on("a20_monthly_by_type", derived, reports.monthly_by_cause)
on("a20_monthly_by_factor", derived, lambda d: reports.monthly_by_cause(d, by="contributing_factors", k=3))
on("a21_type_profile", derived, carers.risk_profile)
on("a21_location_profile", derived, lambda d: carers.risk_profile(d, "location").limit(25))
on("a22_risk_network", derived, carers.risk_network)
on("a23_journey", derived, lambda d: journeys.journey(d, "370"))
on("a23_journeys", derived, journeys.journeys)
on("a23_journey_locations", derived, journeys.journey_locations)
on("a24_correlations", derived, lambda d: correlation.labelled(correlation.correlation_matrix(d, CORRELATED)))
on("a25_leakage_screen", derived, lambda d: correlation.leakage_screen(
    d.withColumn("shadow", F.col("reportable_bin") * 2 + F.when(F.col("incident_id") % 20 == 0, 1).otherwise(0))
))
on("a25_target_distribution", derived, lambda d: correlation.target_distribution(d, "reportable_bin"))
on("a26_largest_histories", derived, reports.largest_histories)
on("a26_locations_by_count", derived, reports.locations_by_count)
on("a27_map_kpis", derived, lambda d: geography.map_kpis(geography.map_points(d)))
on("a28_monthly_trend", derived, reports.monthly_trend)

# --- windows -----------------------------------------------------------------------------------------------------------
on("w1_w2_histories", derived, lambda d: history.with_histories(d).select(
    "incident_id", "participant_prior_incidents", "carer_prior_incidents",
    "participant_total_incidents", "carer_total_incidents",
))
on("w3_fallback_features", derived, history.fallback_features)
on("w5_seasonal_change", raw, lambda d: forecast.forecast(d, 14))
on("w7_cooldown", events, lambda d: gate.with_gate(
    d, ["user_id", "event_type"], "ts", "event_id", 86_400
).select("event_id", "allowed"))
on("w7_cooldown_per_type", events, lambda d: gate.with_gate(d, ["event_type"], "ts", "event_id", 3600, 6, calm_times=100).select("event_id", "allowed"))

# --- sorting, limits, reshaping ----------------------------------------------------------------------------------------
on("t1_t3_worst_delays", derived, lambda d: carers.worst_delay(carers.delay_by_carer(d), 10, "over_1", 15))
on("t2_top_values", derived, lambda d: joins.top_values(d, "carer_id", 20, count="incidents"))
on("u2_distinct_lines", delayed, lambda d: d.select(
    "incident_id", F.array_distinct(F.concat(wording.mitigations(), wording.mitigations())).alias("lines")
))
on("v3_one_hot", derived, lambda d: d.select(
    "incident_id",
    *[value.alias(name) for name, value in (one_hot(d, "location", "loc") | one_hot(d, "incident_type", "type")).items()]
).select("incident_id", "`loc__Unknown`", "`type__Fall`"))


# --- text --------------------------------------------------------------------------------------------------------------
on("x1_factor_labels", raw, lambda d: d.select("incident_id", wording.factor_label("contributing_factors").alias("factor")))


@register("x1_document_labels")
def x1_documents(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    return documents.groupBy(wording.factor_label("text").alias("factor")).agg(F.count(F.lit(1)).alias("count"))


on("x1b_simple_labels", raw, lambda d: d.select(
    "incident_id",
    wording.factor_label(F.concat_ws(";", "contributing_factors", "location"), mode="simple").alias("factor"),
))
on("x2_summaries", delayed, lambda d: d.select(
    "incident_id", wording.incident_summary().alias("summary"), wording.incident_summary("extended").alias("summary_extended")
))
on("x3_mitigations", delayed, lambda d: d.select(
    "incident_id", wording.mitigations().alias("basic"), wording.mitigations("extended").alias("extended")
))
on("x4_prompts", delayed, lambda d: d.select(
    "incident_id", wording.prompt(["incident_id", "incident_type", "severity", "location"], F.col("contributing_factors")).alias("prompt")
))
on("x4_model_summaries", delayed, lambda d: narratives.with_model_summaries(
    d, lambda text: f" {len(text)} characters read ", ["incident_id", "incident_type", "severity", "location"]
).select("incident_id", "summary", "mitigations"))
on("x5_alert_messages", delayed, lambda d: rules.with_alerts(d).select("incident_id", "alert_reason", "alert_message"))


def situations(spark: SparkSession, folder: str) -> DataFrame:
    """The preset situations scored by what the table says: the severe share of the incidents that meet their conditions."""
    table = derived(spark, folder)
    wanted = scenarios.filled_scenarios(scenarios.preset_scenarios(spark))
    place, hour = F.lower(F.col("d.location")), F.col("d.hour")
    met = place.contains(F.col("s.location")) & (F.abs(hour - F.col("s.hour")) <= 2)
    counted = table.groupBy("location", "hour").agg(
        F.count(F.lit(1)).alias("n"), common.count_if(F.col("severity_numeric") >= 3).alias("severe")
    )
    scores = (
        counted.alias("d").join(F.broadcast(wanted.alias("s")), met)  # three situations
        .groupBy(*[F.col(f"s.{name}").alias(name) for name in wanted.columns])
        .agg((F.sum("d.severe") / F.sum("d.n")).alias("risk_score"))
    )
    return scores.withColumn("risk_level", grades.risk_level("risk_score"))


@register("ml11_situation_alerts")
def ml11(spark, folder):
    return scenarios.scenario_alerts(situations(spark, folder), {"high": 0.2, "medium": 0.3})


@register("x6_recommendations")
def x6(spark, folder):
    return situations(spark, folder).select("scenario", wording.recommendation("scenario").alias("recommendation"))


# --- places ------------------------------------------------------------------------------------------------------------
on("g1_suburbs", raw, lambda d: d.select(
    "incident_id", places.suburb("address").alias("suburb"), places.postcode("address").alias("postcode")
))
on("g2_jitter", raw, lambda d: d.select(
    "incident_id",
    places.jitter("address", F.lit(-33.8915))[0].alias("shift_lat"),
    places.jitter("address", F.lit(-33.8915))[1].alias("shift_lon"),
))
on("g3_coordinates", derived, lambda d: geography.with_coordinates(d).select("incident_id", "latitude", "longitude"))
on("g3_location_names", derived, lambda d: geography.with_coordinates(d.withColumns({
    "address": F.when(F.col("incident_id") % 2 == 0, F.col("address")),
    "location": F.when(F.col("incident_id") % 3 == 0, "Near bondi or Sydney").when(F.col("incident_id") % 3 == 1, "PENRITH day centre").otherwise(F.col("location")),
})).select("incident_id", "latitude", "longitude"))
on("g4_place_points", derived, lambda d: geography.with_place_points(
    d.withColumn("location", F.when(F.col("incident_id") % 2 == 0, F.col("location")).otherwise(
        F.regexp_replace("address", ", NSW", " NSW")))
).select("incident_id", "lat", "lon"))
on("g5_density", derived, lambda d: geography.density(geography.map_points(d)))
on("g5_hotspots", derived, lambda d: geography.hotspots(geography.density(geography.map_points(d))))
on("g6_geocode_requests", raw, lambda d: geography.geocode_requests(d, "address"))

# --- forecasts ---------------------------------------------------------------------------------------------------------
def off_ties(parts: DataFrame) -> DataFrame:
    """Shares of counts end in a 5 at the seventh digit at times, where the order of sums would decide how they are rounded."""
    return parts.withColumns({name: F.col(name) + 1e-9 for name in ("trend", "season", "rest")})


on("d1_additive", raw, lambda d: off_ties(decomposition.additive(d)))
on("d1_additive_by_location", derived, lambda d: off_ties(decomposition.additive(d, ["location"])))
on("d1_additive_short_series", raw, lambda d: off_ties(decomposition.additive(d, ["participant_id"])))
on("d2_robust_by_location", derived, lambda d: decomposition.robust(d, ["location"]))
on("d3_portmanteau_of_rests", derived, lambda d: decomposition.portmanteau(
    decomposition.rests(decomposition.additive(d, ["location"]), ["location"])).select("location", "n", "q"))
on("d4_stationarity", derived, lambda d: decomposition.stationarity(
    forecast.monthly_series(d, ["location"])).select("location", "unit_root", "lags"))
on("m1_forecast", raw, lambda d: forecast.forecast(d, 6))
on("m1_forecast_by_location", derived, lambda d: forecast.forecast(d, 6, ["location"]))
on("m1_forecast_line", raw, lambda d: forecast.forecast(d, 6, ["participant_id"]))
on("m1_forecast_mean", raw, lambda d: forecast.forecast(
    d.withColumn("pair", F.concat_ws("/", "participant_id", "incident_type")), 6, ["pair"]
))
on("m1_forecast_flat", raw, lambda d: forecast.forecast(d, 6, ["carer_id"], flat=True))
on("m2_forecast_log", raw, lambda d: forecast.forecast(d, 6, ["carer_id"], log_space=True))

# --- models ------------------------------------------------------------------------------------------------------------
on("ml1_prepared", prepared, lambda d: d.select(
    "incident_id", "incident_datetime", "incident_weekday", "severity", "severity_numeric", "location",
    "medical_attention_required_bin", "reportable_bin", "hour", "day_of_week", "is_weekend", "day_type",
    "participant_prior_incidents", "carer_prior_incidents", "participant_total_incidents", "carer_total_incidents",
    "location_risk_score", "is_kitchen", "is_bathroom", "investigation_required", "action_complete",
))


@register("ml2_features")
def ml2(spark, folder):
    frame = feature_frame(prepared(spark, folder), names_from=derived(spark, folder)).frame
    return frame.select(
        "incident_id", "hour", "is_weekend", "is_kitchen", "is_bathroom", "participant_incident_count",
        "carer_incident_count", "location_risk_score", "severity_numeric",
    )


@register("ml3_guard_report")
def ml3(spark, folder):
    table = classifiers.with_label(derived(spark, folder)).withColumn("label_copy", F.col("label") * 1.0)
    model = LeakageGuard(GUARD_CANDIDATES, corr_threshold=0.8).fit(table)
    return model.report(spark).select("feature", "category", "reason", "value", "kept")


on("ml4_target", derived, lambda d: classifiers.with_label(d).groupBy("label").agg(F.count(F.lit(1)).alias("count")))
on("ml5_time_split", derived, lambda d: splits.time_split(d).groupBy("is_test").agg(
    F.count(F.lit(1)).alias("count"), F.min("incident_datetime").alias("first"), F.max("incident_datetime").alias("last")
))
on("ml5_stratified_split", derived, lambda d: splits.stratified_split(classifiers.with_label(d)).groupBy("label", "is_test").agg(
    F.count(F.lit(1)).alias("count")
))
on("ml5_group_split", derived, lambda d: splits.group_split(d, "participant_id").groupBy("is_test").agg(
    F.count_distinct("participant_id").alias("participants")
))
on("ml8_folds", derived, lambda d: splits.with_folds(classifiers.with_label(d), 3).groupBy("label", "fold").agg(
    F.count(F.lit(1)).alias("count")
))


def trained(spark: SparkSession, folder: str, cross_validate: bool = False) -> dict:
    return classifiers.compare_models(
        prepared(spark, folder), cross_validate=cross_validate, names_from=derived(spark, folder)
    )


@register("ml6_ml7_ml9_models")
def ml9(spark, folder):
    return classifiers.model_table(trained(spark, folder), spark)


@register("ml8_cross_validation")
def ml8(spark, folder):
    return classifiers.model_table(trained(spark, folder, cross_validate=True), spark)


@register("ml10_risk_scores")
def ml10(spark, folder):
    best = classifiers.best_model(trained(spark, folder))
    rows = prepared(spark, folder).select(
        "incident_id", "hour", "location", "day_type", F.col("participant_prior_incidents").alias("participant_history"),
        F.col("carer_prior_incidents").alias("carer_history"), F.col("location_risk_score").alias("location_risk"),
    )
    return scenarios.risk_scores(rows, best).select("incident_id", "risk_score", "risk_level", "model_used")


@register("e3_feature_ranking")
def e3(spark, folder):
    return classifiers.feature_ranking(classifiers.best_model(trained(spark, folder)), spark)


# --- facts about trained models that SQL can state --------------------------------------------------------------------
def flag(condition) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


@register("ml7_ml9_prediction_facts")
def prediction_facts(spark, folder):
    """Predictions cover exactly the test rows, scores are chances, and the cells of the confusion matrix sum to the rows."""
    found = []
    for name, model in trained(spark, folder).items():
        p, cells = F.col("probability"), evaluation.confusion_matrix(model.predictions).agg(F.sum("count").cast("bigint")).first()[0]
        wrong = ((p > 0.5 + 1e-9) & (F.col("prediction") != 1)) | ((p < 0.5 - 1e-9) & (F.col("prediction") != 0))
        found.append(model.predictions.agg(
            F.lit(name).alias("model"), F.count(F.lit(1)).alias("rows"), F.count_distinct("incident_id").alias("ids"),
            F.sum("label").cast("bigint").alias("positives"), F.lit(cells).cast("bigint").alias("cells"),
            F.count_if(p.isNull() | F.isnan(p) | (p < 0) | (p > 1)).alias("bad_scores"), F.count_if(wrong).alias("wrong_sides"),
        ))
    return reduce(DataFrame.unionByName, found)


@register("ml8_fold_facts")
def fold_facts(spark, folder):
    table = classifiers.model_table(trained(spark, folder, cross_validate=True), spark)
    return table.select(
        "model", flag(F.col("accuracy").between(0, 1)).alias("accuracy_ok"), flag(F.col("cv_accuracy").between(0, 1)).alias("mean_ok"),
        flag(F.col("cv_deviation").between(0, 0.5)).alias("deviation_ok"), flag(F.col("features") > 0).alias("features_ok"),
        flag(F.col("suspicious") == (F.col("accuracy") >= 0.98)).alias("suspicious_ok"),
        flag(F.col("overfitted") == ((F.col("accuracy") >= 0.98) & (F.col("cv_accuracy") < 0.9))).alias("overfitted_ok"),
    )


@register("ml10_score_facts")
def score_facts(spark, folder):
    """A score for every incident; levels do not overlap."""
    scores = ml10(spark, folder)
    ranges = scores.groupBy("risk_level").agg(F.min("risk_score").alias("low"), F.max("risk_score").alias("high"))
    overlaps = ranges.alias("a").join(ranges.alias("b"), F.expr("a.risk_level != b.risk_level and a.low <= b.high and b.low <= a.high"))
    return common.beside(scores.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("incident_id").alias("ids"),
        F.count_if(F.col("risk_score").isNull() | ~F.col("risk_score").between(0, 1)).alias("bad_scores"),
    ), overlaps.agg(F.count(F.lit(1)).alias("overlaps")))


@register("t4_e3_ranking_facts")
def ranking_facts(spark, folder):
    """Every ranking is sorted, has no negative value, and at most 20 features, as many as the model has."""
    found = []
    for name, model in trained(spark, folder).items():
        rows = classifiers.feature_ranking(model, spark).collect()  # 20 at most
        values = [row["importance"] for row in rows]
        found.append((name, int(values == sorted(values, reverse=True)), int(min(values) >= 0), int(len(rows) == min(20, len(model.feature_names)))))
    return spark.createDataFrame(found, "model string, sorted int, positive int, complete int")


@register("ml10_ml11_trained_alerts")
def trained_alerts(spark, folder):
    """Presets scored by a forest that has learnt a planted label, incidents from 5 to 7 o'clock, and the alerts of these scores."""
    planted = prepared(spark, folder).withColumn("target", F.when(F.col("hour").between(5, 7), 1).otherwise(0))
    models = classifiers.compare_models(planted, "target", "random", cross_validate=False, names_from=derived(spark, folder))
    filled = scenarios.filled_scenarios(scenarios.preset_scenarios(spark))
    raised = scenarios.scenario_alerts(scenarios.risk_scores(filled, models["RandomForest"]), {"high": 0.5, "medium": 0.5})
    return raised.select("scenario", "severity", "hour", "location", "threshold", "model_used", "recommendation")


def cluster_facts(placed: DataFrame, row_id: str, names: list[str]) -> DataFrame:
    """All rows once, the clusters that have rows, and centred, uncorrelated components in the order of their spread."""
    spread = [F.var_pop(name) for name in names]
    centred = reduce(lambda a, b: a & b, [F.abs(F.avg(name)) < 1e-6 for name in names])
    apart = F.abs(F.covar_pop(names[0], names[1])) < 1e-6 * (spread[0] + 1)
    ordered_ones = reduce(lambda a, b: a & b, [a >= b - 1e-9 for a, b in zip(spread, spread[1:])])
    return placed.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(row_id).alias("ids"), F.count_distinct("cluster").alias("clusters"),
        flag(centred).alias("centred"), flag(apart).alias("apart"), flag(ordered_ones).alias("in_order"),
    )


on("cl1_cluster_facts", lambda spark, folder: cl1(spark, folder), lambda d: cluster_facts(d, "incident_id", ["pc1", "pc2"]))
on("cl2_cluster_facts", lambda spark, folder: cl2(spark, folder), lambda d: cluster_facts(d, "incident_id", ["pc1", "pc2", "pc3"]))
on("cl1_embedding_cluster_facts", lambda spark, folder: cl1_embeddings(spark, folder), lambda d: cluster_facts(d, "vec_id", ["pc1", "pc2"]))

on("e1_confusion_matrix", scored, evaluation.confusion_matrix)
on("e1_class_metrics", scored, evaluation.class_metrics)
on("e2_roc_points", scored, evaluation.roc_points)
on("e2_precision_recall_points", scored, evaluation.precision_recall_points)
on("e2_curve_areas", scored, evaluation.curve_areas)
on("w6_score_steps", scored, lambda d: evaluation.score_steps(d).select(
    "probability", "positives", "negatives", "tp_before", "fp_before", "all_positives", "all_negatives"
))
on("q21_exact_percentiles", derived, lambda d: ordered.exact_percentiles(d, {
    "age_p80": ("participant_age", 0.8), "age_median": ("participant_age", 0.5), "delay_p90": ("report_delay_hours", 0.9),
}))


def with_fold(table: DataFrame) -> DataFrame:
    return table.withColumn("fold", (F.col("incident_id") % 5).cast("int"))


on("e4_isotonic_blocks", scored, lambda d: calibration.isotonic(with_fold(d), fold="fold").select("fold", "low", "hits", "n", "rate"))
on("e4_calibrated", scored, lambda d: calibration.calibrated(with_fold(d), fold="fold").select("incident_id", "fold", "probability", "calibrated"))
on("e4_reliability", scored, calibration.reliability)
on("e4_reliability_calibrated", scored, lambda d: calibration.reliability(calibration.calibrated(with_fold(d), fold="fold"), "calibrated"))


@register("cl1_clusters")
def cl1(spark, folder):
    frame = clustering.cluster_features(prepared(spark, folder), names_from=derived(spark, folder))
    return clustering.clusters(frame, k=4, components=2)


@register("cl2_clusters_scaled")
def cl2(spark, folder):
    frame = clustering.cluster_features(prepared(spark, folder), names_from=derived(spark, folder))
    return clustering.clusters(frame, k=4, components=3, scaled=True)


@register("cl1_embedding_clusters")
def cl1_embeddings(spark, folder):
    table = clustering.numeric_frame(embedding_columns(spark, folder).drop("label"), "vec_id")
    return clustering.clusters(table, "vec_id", k=10, starts=3)


def embedding_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return similarity.unit_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"), "vec_id", ["embedding"])


@register("si1_similar_rows")
def si1(spark, folder):
    vectors = embedding_vectors(spark, folder)
    return similarity.similar(vectors, vectors.where("id % 20 = 0"), 5)


@register("t5_si1_similar_incidents")
def si1_incidents(spark, folder):
    table = clustering.numeric_frame(
        derived(spark, folder), "incident_id", ["hour", "is_weekend", "is_kitchen", "is_bathroom", "severity_numeric", "participant_age"]
    )
    names = [name for name in table.columns if name != "incident_id"]
    vectors = similarity.unit_vectors(table, "incident_id", names)
    return similarity.similar(vectors, vectors.where("id % 20 = 0"), 5)


@register("tx1_similar_texts")
def similar_texts(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return narrative_search.similar_texts(docs, F.col("doc_id") % 20 == 0, 5, "doc_id", "text")


@register("tx1_term_weights")
def term_weights(spark, folder):
    """Number of terms and the least and largest weight of every document, all terms kept."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    vectors = narrative_search.tfidf_vectors(docs, "doc_id", "text", F.lit(True))
    return vectors.select(
        F.col("id").alias("doc_id"), F.size("terms").cast("bigint").alias("terms"), F.array_min("weights").alias("least"), F.array_max("weights").alias("most")
    )


@register("si2_similar_to_all")
def si2(spark, folder):
    return similarity.similar_to_all(embedding_vectors(spark, folder), 3)


# --- alerts ------------------------------------------------------------------------------------------------------------
def with_repeats(table: DataFrame) -> DataFrame:
    """Every incident twice at its own time, and again 30 minutes and 2 hours later."""
    later = [table.withColumn("incident_datetime", F.col("incident_datetime") + F.expr(f"interval {n} minutes")) for n in (0, 30, 120)]
    return table.unionByName(later[0]).unionByName(later[1]).unionByName(later[2])


on("st1_route", delayed, lambda d: alerts.route(with_repeats(d), ["sms", "email"]).select(
    "incident_id", "alert_reason", "channel", "incident_datetime", "result"
))
on("st1_route_without_channels", delayed, lambda d: alerts.route(d, []).groupBy("result").agg(F.count(F.lit(1)).alias("count")))


@register("st2_st3_s6_stream_outbox")
def st3(spark, folder):
    schema = events(spark, folder).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    keyed = alerts.keyed_alerts(stream, ["user_id", "event_type"], "ts", "event_id")
    outbox, state = scratch_path(spark, "outbox"), scratch_path(spark, "outbox-state")
    query = alerts.deliver(alerts.gate_stream(keyed, 86_400), outbox, state)
    query.awaitTermination()
    return alerts.read_outbox(spark, outbox).select("alert_id", "event_time")


@register("st1_st3_route_stream")
def route_stream(spark, folder):
    """Repeats at the same time in a first run; in a second one 2 hours later, 3 hours late, and early incidents that are new."""
    incidents, arrivals, outbox, state = (scratch_path(spark, name) for name in ("incidents", "arrivals", "outbox", "outbox-state"))
    table = settle(delayed(spark, folder).select(*alerts.READ), path=incidents)

    def arrive(*moves: tuple[int, int], last: bool = False) -> None:
        """Each incident, stored once, with by how many minutes and by what its time and id are moved in each of its copies."""
        copies = F.array(*[F.struct(F.lit(minutes).alias("minutes"), F.lit(shift).cast("bigint").alias("shift")) for minutes, shift in moves])
        table.withColumn("moves", copies).write.mode("append").parquet(arrivals)
        if last:
            drop_scratch(spark, incidents)
        stream = spark.readStream.schema(f"{ddl}, moves array<struct<minutes int, shift bigint>>").parquet(arrivals).select("*", F.inline("moves")).drop("moves")
        moved = {"incident_datetime": F.expr("incident_datetime + make_dt_interval(0, 0, minutes)"), "incident_id": F.expr("incident_id + shift")}
        rows = stream.withColumns(moved).select(*alerts.READ)
        alerts.deliver(alerts.route_stream(rows, ["sms", "email"]), outbox, state).awaitTermination()

    ddl = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in table.schema.fields)
    arrive((0, 0), (0, 0))
    arrive((120, 0), (-180, 0), (-6000, 1_000_000_000), last=True)
    drop_scratch(spark, arrivals, state)
    return alerts.read_results(spark, outbox).select("alert_id", "reason", "channel", "message", "event_time", "result")
