"""A few literal answers for each fixed table, written out here and not taken from the package."""

import pytest
from pyspark.sql import functions as F

from incidentry.functions import clock, grades, places, wording
from incidentry.models import scenarios
from incidentry.operators import geography


def answers(spark, values, kind, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(build("v")).collect()]


@pytest.mark.parametrize(
    "build, kind, pairs",
    [
        (grades.normal_severity, "string", {"minor": "Low", " SEVERE ": "Critical", "Moderate": "Medium", "major": "High", "?": "Medium", None: "Medium"}),
        (lambda v: grades.severity_rank(F.col(v)), "string", {"Low": 1, "Medium": 2, "High": 3, "Critical": 4, "x": None}),
        (clock.time_frame_hours, "string", {"Immediate": 0, "Within 24 hours": 12, "24-48 hours": 36, "48-72 hours": 60, "More than 72 hours": 96, None: 24}),
        (clock.is_prompt_time_frame, "string", {"Immediate": True, "Within 24 hours": True, "24-48 hours": False}),
        (grades.workload_band, "double", {15.0: "High Volume (15+/month)", 14.9: "Medium Volume (8-14/month)", 3.0: "Low Volume (3-7/month)", 2.9: "Very Low Volume (<3/month)"}),
        (grades.compliance_band, "double", {95.0: "Good (95-100%)", 85.0: "Monitoring (85-94%)", 70.0: "Needs Support (70-84%)", 69.9: "Immediate Attention (<70%)"}),
        (grades.delay_band, "double", {1.0: "Excellent (<1 day)", 2.0: "Good (1-2 days)", 3.0: "Needs Attention (2-3 days)", 3.1: "Poor (>3 days)"}),
        (places.suburb, "string", {"12 George St, Bondi, NSW 2026": "BONDI", "x": None}),
        (places.postcode, "string", {"3 Hunter St, Newcastle, nsw 2300": "2300"}),
        (places.looks_like_street, "string", {"12 George St, Bondi NSW 2026": True, "Group Home": False}),
    ],
)
def test_bands_words_and_places(spark, build, kind, pairs):
    assert answers(spark, list(pairs), kind, build) == list(pairs.values())


def test_named_places_and_suburbs(spark):
    points = geography.with_place_points(spark.createDataFrame([("Group Home",), ("Care Home 3",), ("Elsewhere",)], "location string"))
    assert {r["location"]: (r["lat"], r["lon"]) for r in points.collect()} == {
        "Group Home": (-33.8707, 151.2069), "Care Home 3": (-33.862, 151.217), "Elsewhere": (None, None),
    }
    assert {r["suburb"]: r["suburb_lat"] for r in geography.centroids(spark).collect()}["WOLLONGONG"] == -34.4278


def test_alert_rules_in_order(spark):
    rows = [
        ("Critical", "Fall", 0.0, 0, "high_severity"),
        ("4", "Self-Harm", 0.0, 0, "high_severity"),
        ("Low", "Possible harm", 5.0, 1, "self_harm_risk"),
        ("Low", "Fall", 1.5, 1, "late_notification"),
        ("Moderate", "Fall", 1.0, 1, "reportable_moderate"),
        ("Moderate", "Fall", 1.0, 0, None),
        ("Low", "Fall", None, 1, None),
    ]
    df = spark.createDataFrame([(*row, i) for i, row in enumerate(rows)], "severity string, incident_type string, notification_delay_days double, "
                               "reportable_bin int, expected string, i int")
    got = df.orderBy("i").select(wording.alert_reason().alias("reason"), "expected").collect()
    assert [r["reason"] for r in got] == [row[4] for row in rows]


def test_presets_and_recommendations(spark):
    filled = {r["scenario"]: (r["hour"], r["participant_history"], r["carer_history"], r["location_risk"], r["severity"])
              for r in scenarios.filled_scenarios(scenarios.preset_scenarios(spark)).collect()}
    assert filled == {
        "Early Morning Kitchen Risk": (6, 3, 5, 3, "HIGH"),
        "High-Risk Combination": (8, 5, 10, 1, "MEDIUM"),
        "Weekend Transport Risk": (8, 3, 5, 2, "MEDIUM"),
    }
    lines = spark.createDataFrame([("Weekend Transport Risk",), ("other",)], "s string").select(wording.recommendation("s")).collect()
    assert [list(r[0]) for r in lines] == [
        ["Ensure additional safety protocols", "Verify transport safety equipment", "Consider companion support"],
        ["Review safety protocols", "Increase supervision"],
    ]
