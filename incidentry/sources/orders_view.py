"""Incident rows derived from the TPC-H-like order tables.

The expressions read the same in Spark SQL and in other SQL engines, and use the order key only through integer arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from incidentry.session import use_utc

CARER_NUMBER = "CAST(floor((o_orderkey * 7 % 97) * (o_orderkey * 7 % 97) / 200.0) AS INT)"

EXPRESSIONS = {
    "incident_id": "o_orderkey",
    "participant_id": "CAST(o_custkey AS STRING)",
    "carer_id": f"'C' || lpad(CAST({CARER_NUMBER} AS STRING), 3, '0')",
    "incident_date": "o_orderdate",
    "incident_time": (
        "lpad(CAST(o_orderkey * 13 % 24 AS STRING), 2, '0') || ':' || lpad(CAST(o_orderkey * 7 % 60 AS STRING), 2, '0')"
    ),
    "notification_date": (
        "CASE WHEN o_orderkey % 50 = 49 THEN NULL ELSE "
        f"o_orderdate + ({CARER_NUMBER} * 20 % 47) * (o_orderkey * 31 % 53) * INTERVAL '6' MINUTE END"
    ),
    "severity": (
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'severe' WHEN '2-HIGH' THEN ' High ' WHEN '3-MEDIUM' THEN 'moderate' "
        "WHEN '5-LOW' THEN 'minor' ELSE 'n/a' END"
    ),
    "incident_type": (
        "CASE o_orderkey % 8 WHEN 0 THEN 'Self-Harm' WHEN 1 THEN 'Medication Error' WHEN 2 THEN 'Fall' WHEN 3 THEN 'Assault' "
        "WHEN 4 THEN 'Property Damage' WHEN 5 THEN 'Unethical Behavior' WHEN 6 THEN 'Fall' ELSE 'Transport Incident' END"
    ),
    "location": (
        "CASE o_orderkey % 11 WHEN 0 THEN 'kitchen' WHEN 1 THEN ' Bathroom ' WHEN 2 THEN 'Transport Vehicle' "
        "WHEN 3 THEN 'Day Program' WHEN 4 THEN NULL WHEN 5 THEN 'Group Home' ELSE n_name END"
    ),
    "address": (
        "CASE o_orderkey % 9 WHEN 0 THEN '12 George St, Bondi, NSW 2026' WHEN 1 THEN '3 Hunter St, Newcastle, nsw 2300' "
        "WHEN 2 THEN '7 Church St, Parramatta, NSW 2150' WHEN 3 THEN '9 Nowhere Rd, Atlantis, NSW 2999' WHEN 4 THEN NULL "
        "WHEN 5 THEN 'Group Home' ELSE CAST(o_orderkey % 40 AS STRING) || ' High St, Penrith, NSW 2750' END"
    ),
    "reportable": "o_orderstatus = 'F'",
    "medical_attention_required": "o_orderkey % 5 = 0",
    "treatment_required": "o_orderkey % 7 = 0",
    "actions_documented": "o_orderkey % 3 = 0",
    "medical_outcome": "CASE o_orderkey % 4 WHEN 0 THEN 'Recovered' WHEN 1 THEN 'Ongoing' ELSE NULL END",
    "notification_time_frame": (
        "CASE o_orderkey % 6 WHEN 0 THEN 'Immediate' WHEN 1 THEN 'Within 24 hours' WHEN 2 THEN '24-48 hours' "
        "WHEN 3 THEN '48-72 hours' WHEN 4 THEN 'More than 72 hours' ELSE NULL END"
    ),
    "contributing_factors": (
        "CASE o_orderkey % 7 WHEN 0 THEN 'Wet floor not clearly marked' WHEN 1 THEN 'Staff fatigue after long day' "
        "WHEN 2 THEN 'History of chronic illness' WHEN 3 THEN 'Purple elephants dancing nightly' WHEN 4 THEN 'of the and' "
        "WHEN 5 THEN NULL ELSE 'Lack of training on policy' END"
    ),
    "participant_age": "CAST(CASE WHEN o_custkey % 20 = 0 THEN NULL ELSE 10 + o_custkey % 80 END AS INT)",
    # beyond the basic view: reporters, birth dates, given coordinates and flags kept as text
    "reported_by": (
        "CASE o_orderkey % 6 WHEN 0 THEN 'Team  Leader' WHEN 1 THEN 'Support Worker' WHEN 2 THEN NULL WHEN 3 THEN 'Family' "
        "ELSE 'Worker ' || CAST(o_custkey % 30 AS STRING) END"
    ),
    "dob": (
        "CASE WHEN o_custkey % 25 = 0 THEN NULL ELSE make_date(CAST(1930 + o_custkey % 80 AS INT), "
        "CAST(1 + o_custkey % 12 AS INT), CAST(1 + o_custkey % 28 AS INT)) END"
    ),
    "latitude": (
        "CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 THEN CAST(-34 AS DOUBLE) + (o_orderkey % 100) / CAST(1000 AS DOUBLE) "
        "ELSE NULL END"
    ),
    "longitude": (
        "CASE WHEN o_orderkey % 13 = 0 THEN CAST(151 AS DOUBLE) + (o_orderkey % 90) / CAST(1000 AS DOUBLE) ELSE NULL END"
    ),
    "medical_text": (
        "CASE o_orderkey % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN ' n ' WHEN 2 THEN 'TRUE' WHEN 3 THEN 'Required' WHEN 4 THEN NULL "
        "ELSE 'maybe' END"
    ),
    "reportable_text": (
        "CASE o_orderkey % 5 WHEN 0 THEN '1' WHEN 1 THEN '0' WHEN 2 THEN '2.5' WHEN 3 THEN 'yes' ELSE NULL END"
    ),
}

JOINED = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


def incidents(spark: SparkSession, folder: str) -> DataFrame:
    """One incident per order. No join hint: nations are a small file, customers grow with the orders."""
    use_utc(spark)
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    customer = spark.read.parquet(f"{folder}/customer.parquet").select("c_custkey", "c_nationkey")
    nation = spark.read.parquet(f"{folder}/nation.parquet").select("n_nationkey", "n_name")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(
        nation, customer.c_nationkey == nation.n_nationkey
    )
    return joined.selectExpr(*[f"{text} AS {name}" for name, text in EXPRESSIONS.items()])
