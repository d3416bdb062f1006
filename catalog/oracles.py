"""SQL for DuckDB that answers the registered queries from the same tables, written apart from the Spark operators."""

from __future__ import annotations

from catalog.tables import AS_OF
from incidentry import fixed_values as fixed
from incidentry.sources.orders_view import EXPRESSIONS, JOINED

ORACLES: dict[str, str] = {}


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def cases(value: str, table, otherwise: str) -> str:
    arms = " ".join(f"WHEN {text(key) if isinstance(key, str) else key} THEN {text(v) if isinstance(v, str) else v}" for key, v in table)
    return f"CASE {value} {arms} ELSE {otherwise} END"


def title(value: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({value}, '[A-Za-z]+|[^A-Za-z]+'), "
        "lambda p: upper(p[1]) || lower(p[2:])), '')"
    )


def r6(value: str) -> str:
    return f"round(CAST({value} AS DOUBLE), 6) + 0.0"


def day(value: str) -> str:
    return f"strftime({value}, '%Y-%m-%d')"


def stamp(value: str) -> str:
    return f"strftime({value}, '%Y-%m-%d %H:%M:%S')"


def hours(start: str, end: str) -> str:
    return f"((epoch_us({end}) - epoch_us({start})) / 3600000000.0)"


def days(start: str, end: str) -> str:
    return f"CAST(floor((epoch_us({end}) - epoch_us({start})) / 86400000000.0) AS INT)"


INCIDENTS = "incidents AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in EXPRESSIONS.items()) + f" FROM {JOINED})"
SEVERITY = cases("lower(trim(severity))", fixed.SEVERITY_WORDS.items(), "'Medium'")
PROMPT_FRAME = "coalesce(regexp_matches(lower(notification_time_frame), '24 hour|within 24|immediate'), false)"
DERIVED = f"""{INCIDENTS},
d0 AS (
  SELECT * EXCLUDE (severity, location), severity AS raw_severity, {SEVERITY} AS severity,
    {title("trim(coalesce(location, 'Unknown'))")} AS location,
    coalesce(TRY_CAST(strftime(incident_date, '%Y-%m-%d') || ' ' || incident_time AS TIMESTAMP), incident_date) AS incident_datetime,
    (lower(severity) = 'high' OR reportable OR lower(trim(incident_type)) IN ('unethical behavior', 'assault', 'unauthorized restraints')
      OR medical_attention_required OR treatment_required) AS investigation_required,
    (coalesce(lower(trim(medical_outcome)), '') = 'recovered'
      OR (lower(severity) = 'low' AND NOT (medical_attention_required OR treatment_required)) OR actions_documented) AS action_complete,
    {hours('incident_date', 'notification_date')} AS report_delay_hours,
    {days('incident_date', 'notification_date')} AS delay_days
  FROM incidents WHERE incident_date IS NOT NULL),
d AS (
  SELECT *, dayname(incident_date) AS incident_weekday,
    {cases('severity', fixed.SEVERITY_RANK.items(), 'NULL')} AS severity_numeric,
    CAST(reportable AS INT) AS reportable_bin, CAST(medical_attention_required AS INT) AS medical_bin,
    CAST(hour(incident_datetime) AS INT) AS hour, CAST(isodow(incident_datetime) - 1 AS INT) AS day_of_week,
    CAST(isodow(incident_datetime) >= 6 AS INT) AS is_weekend,
    CAST(regexp_matches(lower(location), 'kitchen') AS INT) AS is_kitchen,
    CAST(regexp_matches(lower(location), 'bathroom|toilet|washroom|restroom') AS INT) AS is_bathroom,
    coalesce(report_delay_hours <= 24, false) AS within_24h, coalesce(report_delay_hours > 24, false) AS over_24h,
    strftime(incident_date, '%Y-%m') AS month_label, date_trunc('month', incident_date) AS month
  FROM d0)"""


def over_incidents(name: str, body: str, *more: str) -> None:
    ORACLES[name] = f"WITH {', '.join([INCIDENTS, *more])} {body}"


def over_derived(name: str, body: str, *more: str) -> None:
    ORACLES[name] = f"WITH RECURSIVE {', '.join([DERIVED, *more])} {body}"


# --- sources -----------------------------------------------------------------------------------------------------------
over_incidents("s1_read_csv", f"""SELECT incident_id, {stamp('incident_date')} AS incident_date, incident_time,
  {stamp('notification_date')} AS notification_date, trim(severity) AS severity, trim(location) AS location,
  CAST(reportable AS INT) AS reportable, participant_age, {stamp('dob')} AS dob, {r6('latitude')} AS latitude,
  dayname(incident_date) AS incident_weekday FROM incidents""")
over_incidents("s2_drop_undated", f"SELECT incident_id, {stamp('notification_date')} AS incident_date FROM incidents WHERE notification_date IS NOT NULL")
over_incidents("s3_weekday", "SELECT incident_id, dayname(incident_date) AS incident_weekday FROM incidents")
over_incidents("s4_surrogate_ids", f"""SELECT row_number() OVER (ORDER BY incident_date,
  md5(coalesce(incident_time, '') || '|' || coalesce(participant_id, '') || '|' || coalesce(carer_id, '') || '|' || coalesce(incident_type, '')),
  incident_time, participant_id, carer_id, incident_type) AS incident_id, {stamp('incident_date')} AS incident_date, incident_time, participant_id, carer_id, incident_type FROM incidents""")
over_derived("s5_prepared_by_month", "SELECT month_label AS incident_month, count(*) AS count FROM d GROUP BY 1")

# --- normalising -------------------------------------------------------------------------------------------------------
TRUE_LIST = ", ".join(text(word) for word in fixed.TRUE_WORDS)
over_incidents("n1_flags", f"""SELECT incident_id, CAST(reportable AS INT) AS from_boolean,
  CAST(coalesce(participant_age, 0) > 0 AS INT) AS from_number,
  CAST(coalesce(lower(trim(medical_text)) IN ({TRUE_LIST}), false) AS INT) AS from_words,
  CAST(coalesce(TRY_CAST(reportable_text AS DOUBLE), 0) > 0 AS INT) AS from_number_text FROM incidents""")
over_incidents("n2_severity", f"SELECT incident_id, {SEVERITY} AS severity FROM incidents")
over_incidents("n3_severity_rank", f"""SELECT incident_id, {cases(SEVERITY, fixed.SEVERITY_RANK.items(), 'NULL')} AS severity_numeric,
  CASE trim(severity) WHEN 'High' THEN 3 ELSE 2 END AS variant FROM incidents""")
JOINED_TIME = f"{day('incident_date')} || ' ' || incident_time || ':00'"
over_incidents("n4_datetime", f"SELECT incident_id, {JOINED_TIME} AS incident_datetime FROM incidents")
ORACLES["n5_ensure_datetime"] = ORACLES["n4_datetime"]
MADE_ID = "regexp_replace(coalesce(reported_by, 'unknown'), '\\s+', '_', 'g') || '_' || CAST(incident_id AS VARCHAR)"
over_incidents("n6_person_ids", f"SELECT incident_id, {MADE_ID} AS participant_id, {MADE_ID} AS carer_id FROM incidents")
over_derived("n7_location", "SELECT incident_id, location FROM d")
over_incidents("n8_flag_columns", """SELECT incident_id, CAST(medical_attention_required AS INT) AS medical_attention_required_bin,
  CAST(reportable AS INT) AS reportable_bin,
  CAST(coalesce(lower(medical_text) IN ('yes', 'true', '1'), false) AS INT) AS medical_plain,
  CAST(coalesce(lower(reportable_text) IN ('yes', 'true', '1'), false) AS INT) AS reportable_plain FROM incidents""")
over_derived("n9_calendar", """SELECT incident_id, hour, day_of_week, is_weekend,
  CASE WHEN is_weekend = 1 THEN 'weekend' ELSE 'weekday' END AS day_type FROM d""")
over_derived("n10_rooms", """SELECT incident_id, is_kitchen, is_bathroom,
  CAST(lower(location) SIMILAR TO '.*(bath|toilet|washroom|restroom).*' AS INT) AS is_bathroom_fallback FROM d""")
over_derived("n11_delay_hours", f"""SELECT incident_id, {r6('report_delay_hours')} AS report_delay_hours,
  CAST(within_24h AS INT) AS within_24h, CAST(over_24h AS INT) AS over_24h,
  CAST(coalesce(report_delay_hours <= 120, false) AS INT) AS within_120h,
  CAST(coalesce(report_delay_hours > 120, false) AS INT) AS over_120h FROM d""")
over_derived("n12_delay_days", "SELECT incident_id, delay_days FROM d")
over_incidents("n13_time_frame", f"""SELECT incident_id,
  {cases('notification_time_frame', fixed.TIME_FRAME_HOURS.items(), '24')} AS hours,
  CAST({PROMPT_FRAME} AS INT) AS within_24h FROM incidents""")
AGE = f"CAST(date_diff('day', CAST(dob AS DATE), DATE '{AS_OF}') // 365 AS INT)"
over_incidents("n14_age", f"""SELECT incident_id, {AGE} AS age, CASE WHEN dob IS NULL THEN 'Unknown' WHEN {AGE} < 18 THEN 'Under 18'
  WHEN {AGE} < 30 THEN '18-29' WHEN {AGE} < 45 THEN '30-44' WHEN {AGE} < 60 THEN '45-59' ELSE '60+' END AS age_range FROM incidents""")
MAP_CATEGORY = """CASE WHEN trim(severity) ILIKE 'crit%' THEN 'Critical' WHEN trim(severity) ILIKE 'high%' THEN 'High'
  WHEN trim(severity) ILIKE 'mod%' THEN 'Moderate' WHEN trim(severity) ILIKE 'med%' THEN 'Medium' ELSE 'Low' END"""
over_incidents("n15_map_severity", f"""SELECT incident_id, {MAP_CATEGORY} AS category,
  {cases(f'({MAP_CATEGORY})', fixed.MAP_SEVERITY_RANK.items(), 'NULL')} AS rank FROM incidents""")
over_incidents("n16_cause", "SELECT coalesce(contributing_factors, 'Unknown') AS cause, count(*) AS count FROM incidents GROUP BY 1")
over_incidents("n17_numeric_frame", f"""SELECT incident_id, coalesce(CAST(participant_age AS DOUBLE), 0.0) AS participant_age,
  {r6('coalesce(latitude, 0)')} AS latitude, {r6('coalesce(longitude, 0)')} AS longitude FROM incidents""")
over_incidents("n18_feature_labels", f"SELECT DISTINCT {title(chr(39) + 'type  ' + chr(39) + ' || incident_type')} AS label FROM incidents")
over_incidents("n19_month_label", "SELECT incident_id, strftime(incident_date, '%Y-%m') AS month FROM incidents")

# --- filters and rules -------------------------------------------------------------------------------------------------
PERIOD = "incident_date BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31'"
over_derived("f1_date_range", f"SELECT incident_id, {stamp('incident_date')} AS incident_date FROM d WHERE {PERIOD}")
over_derived("f2_age_range", "SELECT incident_id, participant_age FROM d WHERE participant_age BETWEEN 20 AND 45")
over_derived("f3_equality", """SELECT incident_id, location, severity, carer_id FROM d WHERE location = 'Bathroom' AND severity = 'High'
  AND incident_type = 'Fall' AND incident_date >= TIMESTAMP '1995-01-01'""")
over_derived("f4_map_filter", f"""SELECT incident_id, severity, incident_type FROM d WHERE {PERIOD}
  AND severity IN ('High', 'Critical') AND incident_type IN ('Fall', 'Assault')""")
over_derived("f5_options", "SELECT DISTINCT location FROM d")
over_derived("f5_bounds", f"""SELECT {stamp('min(incident_date)')} AS min_incident_date, {stamp('max(incident_date)')} AS max_incident_date,
  min(participant_age) AS min_participant_age, max(participant_age) AS max_participant_age FROM d""")
over_derived("f6_f7_investigation", """SELECT incident_id, CAST(investigation_required AS INT) AS investigation_required,
  CAST(action_complete AS INT) AS action_complete FROM d""")
REASON = """CASE WHEN lower(severity) IN ('high', 'critical', '4', '5') THEN 'high_severity'
  WHEN contains(lower(incident_type), 'self') OR contains(lower(incident_type), 'harm') THEN 'self_harm_risk'
  WHEN delay_days > 1 THEN 'late_notification'
  WHEN reportable_bin = 1 AND lower(severity) IN ('moderate', '3') THEN 'reportable_moderate' END"""
over_derived("f8_alert_policy", f"SELECT incident_id, {REASON} AS alert_reason FROM d")
over_derived("f8_alert_policy_raw_severity", f"SELECT {REASON} AS alert_reason, count(*) AS count FROM other GROUP BY 1", """other AS (
  SELECT * EXCLUDE (severity), CASE WHEN incident_id % 2 = 0 THEN 'moderate' ELSE CAST(hour AS VARCHAR) END AS severity FROM d)""")
over_incidents("f9_addresses", r"""SELECT incident_id,
  CAST(coalesce(regexp_matches(address, '[0-9]') AND contains(address, ','), false) AS INT) AS is_address,
  CAST(coalesce(regexp_matches(regexp_replace(address, ', (?i)nsw', ' NSW'), '\d+ [\w ]+, [\w ]+ NSW \d+'), false) AS INT) AS is_street
  FROM incidents""")
WORKLOAD = f"""w0 AS (
  SELECT carer_id, avg(delay_days) AS avg_delay, count(*) AS total_incidents,
    count(*) FILTER (WHERE severity = 'High') AS high_severity_count, CAST(sum(reportable_bin) AS BIGINT) AS reportable_count,
    min(incident_date) AS first_incident, max(incident_date) AS last_incident
  FROM d WHERE notification_date IS NOT NULL GROUP BY carer_id),
w1 AS (SELECT *, {days('first_incident', 'last_incident')} AS date_range FROM w0),
w AS (SELECT *, CASE WHEN date_range > 0 THEN total_incidents / (date_range / 30.44) ELSE total_incidents END AS incidents_per_month,
    avg_delay * 0.4 + high_severity_count * 3.0 / total_incidents + reportable_count * 3.0 / total_incidents AS risk_score FROM w1)"""
over_derived("f10_focus", f"""SELECT carer_id, {r6('avg_delay')} AS avg_delay, focus FROM (
  SELECT carer_id, avg_delay, 'delay' AS focus FROM w WHERE total_incidents >= 3 AND avg_delay > 2 UNION ALL
  SELECT carer_id, avg_delay, 'volume' FROM w WHERE total_incidents >= 3 AND incidents_per_month >= 8 UNION ALL
  SELECT carer_id, avg_delay, 'efficiency' FROM w WHERE total_incidents >= 3 AND incidents_per_month >= 5 AND avg_delay <= 2)""", WORKLOAD)
TOP_CARERS = "SELECT carer_id, count(*) AS incidents FROM d GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"
over_derived("f11_busiest_carers", f"SELECT * FROM ({TOP_CARERS})")
over_derived("t2_top_values", f"SELECT * FROM ({TOP_CARERS})")
STAGES = f"""s AS (SELECT *, {PROMPT_FRAME} AS prompt, investigation_required AND NOT action_complete AS under_investigation,
  NOT action_complete AND NOT {PROMPT_FRAME} AS overdue FROM d)"""
over_derived("f12_stage_rows", f"""SELECT carer_id, incident_id, {stamp('incident_date')} AS incident_date, notification_time_frame,
  CAST({cases('notification_time_frame', fixed.TIME_FRAME_HOURS.items(), '24')} AS DOUBLE) AS report_delay_hours
  FROM s WHERE under_investigation""", STAGES)
over_derived("f13_safe_columns", f"""SELECT incident_id, coalesce(CAST(participant_age AS DOUBLE), 0.0) AS participant_age,
  {r6('coalesce(latitude, 0)')} AS latitude, {r6('coalesce(longitude, 0)')} AS longitude, CAST(hour AS DOUBLE) AS hour,
  CAST(day_of_week AS DOUBLE) AS day_of_week, CAST(is_weekend AS DOUBLE) AS is_weekend, CAST(is_kitchen AS DOUBLE) AS is_kitchen,
  CAST(is_bathroom AS DOUBLE) AS is_bathroom FROM d""")
WORKLOAD_BAND = """CASE WHEN {v} >= 15 THEN 'High Volume (15+/month)' WHEN {v} >= 8 THEN 'Medium Volume (8-14/month)'
  WHEN {v} >= 3 THEN 'Low Volume (3-7/month)' ELSE 'Very Low Volume (<3/month)' END"""
COMPLIANCE_BAND = """CASE WHEN {v} >= 95 THEN 'Good (95-100%)' WHEN {v} >= 85 THEN 'Monitoring (85-94%)'
  WHEN {v} >= 70 THEN 'Needs Support (70-84%)' ELSE 'Immediate Attention (<70%)' END"""
DELAY_BAND = """CASE WHEN {v} <= 1 THEN 'Excellent (<1 day)' WHEN {v} <= 2 THEN 'Good (1-2 days)'
  WHEN {v} <= 3 THEN 'Needs Attention (2-3 days)' ELSE 'Poor (>3 days)' END"""
RISK_BAND = "CASE WHEN {v} > 0.7 THEN 'HIGH' WHEN {v} > 0.4 THEN 'MEDIUM' ELSE 'LOW' END"
over_derived("f14_bands", f"""SELECT {WORKLOAD_BAND.format(v='(report_delay_hours / 10)')} AS workload,
  {COMPLIANCE_BAND.format(v='(participant_age + 15)')} AS compliance, {DELAY_BAND.format(v='(report_delay_hours / 24)')} AS delay,
  {RISK_BAND.format(v='(participant_age / 100)')} AS risk, count(*) AS count FROM d GROUP BY ALL""")
NETWORK = """p AS (
  SELECT carer_id, participant_id, count(*) AS incident_count, round_even(avg(severity_numeric), 3) AS avg_severity,
    round_even(avg(medical_bin), 3) AS medical_rate FROM d GROUP BY 1, 2),
network AS (SELECT *, avg_severity * 0.4 + medical_rate * 0.3 + incident_count / (SELECT max(incident_count) FROM p) * 0.3 AS risk_score FROM p)"""
NETWORK_COLUMNS = f"""carer_id, participant_id, incident_count, {r6('avg_severity')} AS avg_severity, {r6('medical_rate')} AS medical_rate,
  {r6('risk_score')} AS risk_score"""
over_derived("a22_risk_network", f"SELECT {NETWORK_COLUMNS} FROM network", NETWORK)
over_derived("f15_high_risk_pairs", f"""SELECT {NETWORK_COLUMNS} FROM network
  WHERE risk_score > (SELECT quantile_cont(risk_score, 0.8) FROM network)""", NETWORK)

# --- joins -------------------------------------------------------------------------------------------------------------
over_derived("j1_location_risk", f"""SELECT incident_id, location, {r6('avg(severity_numeric) OVER (PARTITION BY location)')}
  AS location_risk_score FROM d""")
over_derived("j2_geocoded_lookup", f"""SELECT d.incident_id, d.location, {r6('a.lat')} AS lat, {r6('a.lon')} AS lon FROM d LEFT JOIN (
  SELECT location, latitude AS lat, longitude AS lon FROM d WHERE latitude IS NOT NULL AND longitude IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY location ORDER BY latitude, longitude) = 1) a USING (location)""")
SUBURB_RE = r"(?i),\s*([A-Za-z ]+),\s*NSW\s*(\d{4})\b"
SUBURB = f"nullif(upper(trim(regexp_extract(address, '{SUBURB_RE}', 1))), '')"
CENTROIDS = "centroids(suburb, lat, lon, place) AS (VALUES " + ", ".join(
    f"({text(n)}, CAST({a} AS DOUBLE), CAST({o} AS DOUBLE), {i})" for i, (n, a, o) in enumerate(fixed.SUBURB_CENTROIDS)
) + ")"
over_incidents("j3_suburb_centroid", f"""SELECT i.incident_id, i.suburb, {r6('c.lat')} AS suburb_lat, {r6('c.lon')} AS suburb_lon
  FROM (SELECT incident_id, {SUBURB} AS suburb FROM incidents) i LEFT JOIN centroids c USING (suburb)""", CENTROIDS)
over_incidents("j4_keyword_centroid", f"""SELECT incident_id, {r6('arg_min(c.lat, c.place)')} AS lat, {r6('arg_min(c.lon, c.place)')} AS lon
  FROM incidents LEFT JOIN centroids c ON contains(lower(address), lower(c.suburb)) GROUP BY incident_id""", CENTROIDS)
over_derived("j6_dense_hours", """SELECT CAST(h AS INT) AS hour, count(d.incident_id) AS count FROM range(24) r(h) LEFT JOIN d
  ON d.hour = h GROUP BY 1""")
over_derived("j7_top_types_or_other", """SELECT CASE WHEN incident_type IN (SELECT incident_type FROM d GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)
  THEN incident_type ELSE 'Other' END AS category, count(*) AS count FROM d GROUP BY 1""")

# --- reports -----------------------------------------------------------------------------------------------------------
over_derived("a1_executive_kpis", """SELECT (SELECT incident_type FROM d GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_type,
  strftime(m, '%B %Y') AS latest_month, (SELECT count(*) FROM d WHERE month = m) AS latest_month_count,
  strftime(m - INTERVAL 1 MONTH, '%B %Y') AS previous_month,
  (SELECT count(*) FROM d WHERE month = m - INTERVAL 1 MONTH) AS previous_month_count,
  (SELECT count(*) FROM d WHERE severity = 'High') AS high_severity, (SELECT count(*) FROM d WHERE reportable) AS reportable
  FROM (SELECT max(month) AS m FROM d)""")
over_derived("a2_side_panel", f"""SELECT count(*) AS filtered_rows, (SELECT count(*) FROM d) AS total_rows,
  {days('min(incident_date)', 'max(incident_date)')} AS days, count(DISTINCT location) AS locations,
  count(DISTINCT incident_type) AS incident_types, {r6('avg(CAST(severity_numeric >= 3 AS INT)) * 100')} AS high_severity_pct,
  {r6('avg(reportable_bin) * 100')} AS reportable_pct FROM d WHERE {PERIOD} AND participant_age BETWEEN 20 AND 60""")
SEVERITIES = "(VALUES ('Low'), ('Medium'), ('High'), ('Critical')) v(severity)"
over_derived("a3_severity_distribution", f"SELECT v.severity, count(d.incident_id) AS count FROM {SEVERITIES} LEFT JOIN d USING (severity) GROUP BY 1")
over_derived("a4_monthly_by_severity", f"""SELECT year_month, v.severity, count(c.incident_id) AS count
  FROM (SELECT DISTINCT month_label AS year_month FROM c0) m CROSS JOIN {SEVERITIES}
  LEFT JOIN c0 c ON c.month_label = m.year_month AND c.severity = v.severity GROUP BY 1, 2""", "c0 AS (SELECT * FROM d)")
over_derived("a5_top_types", "SELECT incident_type, count(*) AS count FROM d GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
over_derived("a5_top_locations", "SELECT location, count(*) AS count FROM d GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
over_derived("a6_daily", f"SELECT {day('incident_date')} AS date, count(*) AS incidents FROM d GROUP BY 1")
over_derived("a6_weekday", """SELECT v.name AS incident_weekday, v.position, count(d.incident_id) AS count FROM (VALUES ('Monday', 0),
  ('Tuesday', 1), ('Wednesday', 2), ('Thursday', 3), ('Friday', 4), ('Saturday', 5), ('Sunday', 6)) v(name, position)
  LEFT JOIN d ON d.incident_weekday = v.name GROUP BY 1, 2""")
over_derived("a6_reportable", "SELECT CASE WHEN reportable THEN 'Reportable' ELSE 'Not Reportable' END AS label, count(*) AS count FROM d GROUP BY 1")
over_derived("a7_hour_by_cause", """SELECT g.cause_group, CAST(h AS INT) AS hour, count(c.incident_id) AS count,
  CAST(sum(count(c.incident_id)) OVER (PARTITION BY h) AS BIGINT) AS total
  FROM (SELECT DISTINCT cause_group FROM c) g CROSS JOIN range(24) r(h) LEFT JOIN c ON c.cause_group = g.cause_group AND c.hour = h GROUP BY 1, h""",
  """top AS (SELECT incident_type FROM d GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)""",
  """c AS (SELECT incident_id, hour, CASE WHEN incident_type IN (FROM top) THEN incident_type ELSE 'Other' END AS cause_group FROM d)""")
over_derived("a8_medical_outcomes", """SELECT count(*) FILTER (WHERE treatment_required) AS treatment_required,
  count(*) FILTER (WHERE medical_attention_required) AS medical_attention_required,
  count(*) FILTER (WHERE NOT treatment_required AND NOT medical_attention_required) AS no_medical_intervention FROM d""")
over_derived("a8_reporter_metrics", f"""SELECT count(DISTINCT reported_by) AS reporter_types, CAST(sum(medical_bin) AS BIGINT) AS medical_attention_required,
  {r6('avg(participant_age)')} AS avg_participant_age FROM d""")
over_derived("a8_operational_cards", f"""SELECT {r6(f'avg({AGE})')} AS avg_participant_age, {r6('avg(reportable_bin) * 100')} AS reportable_rate,
  {r6('avg(medical_bin) * 100')} AS medical_attention_rate, CAST(sum(medical_bin) AS BIGINT) AS medical_attention_required FROM d""")
over_derived("a9_carer_workload", f"""SELECT carer_id, {r6('avg_delay')} AS avg_delay, total_incidents, high_severity_count, reportable_count,
  {stamp('first_incident')} AS first_incident, {stamp('last_incident')} AS last_incident, date_range,
  {r6('incidents_per_month')} AS incidents_per_month, {r6('risk_score')} AS risk_score,
  {WORKLOAD_BAND.format(v='incidents_per_month')} AS workload_category FROM w""", WORKLOAD)
over_derived("a9b_workload_summary", f"""SELECT count(*) FILTER (WHERE incidents_per_month >= 10 AND avg_delay <= 2) AS efficient_high_volume,
  count(*) FILTER (WHERE incidents_per_month >= 10 AND avg_delay > 2) AS overwhelmed_high_volume,
  {r6('corr(avg_delay, total_incidents)')} AS correlation, {r6('avg(incidents_per_month) / avg(avg_delay)')} AS efficiency
  FROM w WHERE total_incidents >= 3""", WORKLOAD)
over_derived("a9b_workload_lists", f"""SELECT CASE WHEN avg_delay <= 1.5 THEN 'high_performer' ELSE 'overloaded' END AS "group", carer_id,
  {r6('round_even(incidents_per_month, 1)')} AS incidents_per_month, {r6('round_even(avg_delay, 1)')} AS avg_delay, total_incidents
  FROM w WHERE total_incidents >= 3 AND incidents_per_month >= 8 AND (avg_delay <= 1.5 OR avg_delay > 3)""", WORKLOAD)
over_derived("a9c_trend_line", f"""SELECT {r6('regr_slope(total_incidents, avg_delay)')} AS slope, {r6('regr_intercept(total_incidents, avg_delay)')} AS intercept,
  {r6('min(avg_delay)')} AS from_delay, {r6('max(avg_delay)')} AS to_delay, count(*) AS carers FROM w WHERE total_incidents >= 3""", WORKLOAD)
over_derived("a10_carer_profile", f"""SELECT carer_id, incidents, {r6('high_crit')} AS high_crit, {r6('med_rate')} AS med_rate,
  {r6('(SELECT quantile_cont(high_crit, 0.8) FROM c)')} AS high_crit_p80,
  {r6('(SELECT quantile_cont(CAST(incidents AS DOUBLE), 0.8) FROM c)')} AS incidents_p80 FROM c""",
  """c AS (SELECT carer_id, count(*) AS incidents, avg(CAST(severity_numeric >= 3 AS INT)) AS high_crit, avg(medical_bin) AS med_rate FROM d GROUP BY 1)""")
over_derived("a11_severe_ages", f"""SELECT CAST(bin AS INT) AS bin, {r6('low + (bin - 1) * ((high - low) / 20.0)')} AS bin_start, count(*) AS count FROM (
  SELECT low, high, least(floor((participant_age - low) / ((high - low) / 20.0)) + 1, 20) AS bin FROM a, (SELECT min(participant_age) AS low,
  max(participant_age) AS high FROM a)) GROUP BY bin, low, high""", "a AS (SELECT participant_age FROM d WHERE severity = 'High' AND participant_age IS NOT NULL)")
over_derived("a12_compliance_kpis", f"""SELECT CAST(sum(reportable_bin) AS BIGINT) AS reportable, count(*) FILTER (WHERE within_24h) AS within_24h,
  {r6('avg(CAST(within_24h AS INT)) * 100')} AS within_24h_pct, count(*) FILTER (WHERE over_24h) AS overdue,
  {r6('avg(CAST(investigation_required AS INT)) * 100')} AS investigation_rate, count(*) FILTER (WHERE investigation_required) AS investigation_required,
  count(*) FILTER (WHERE action_complete) AS action_complete,
  {r6('count(*) FILTER (WHERE action_complete) * 100.0 / count(*) FILTER (WHERE investigation_required)')} AS investigation_status_pct,
  count(*) FILTER (WHERE over_24h) AS compliance_breach FROM d""")
COMPLIANCE = f"""c AS (SELECT carer_id, count(*) FILTER (WHERE within_24h) * 100.0 / count(*) AS compliance_rate, count(*) AS incident_count,
  count(*) FILTER (WHERE severity = 'High') AS high_severity_count, CAST(sum(reportable_bin) AS BIGINT) AS reportable_count FROM d GROUP BY 1),
shown AS (SELECT * FROM c WHERE incident_count >= 3 AND compliance_rate < 95 ORDER BY compliance_rate, carer_id LIMIT 25)"""
COMPLIANCE_COLUMNS = f"""carer_id, {r6('compliance_rate')} AS compliance_rate, incident_count, high_severity_count, reportable_count,
  {COMPLIANCE_BAND.format(v='compliance_rate')} AS category"""
over_derived("a13_compliance_by_carer", f"SELECT {COMPLIANCE_COLUMNS} FROM shown", COMPLIANCE)
over_derived("a13_compliance_all_carers", f"SELECT {COMPLIANCE_COLUMNS} FROM c", COMPLIANCE)
over_derived("a13_compliance_summary", f"""SELECT count(*) FILTER (WHERE compliance_rate < 85) AS below_85,
  count(*) FILTER (WHERE compliance_rate < 70) AS below_70, {r6('avg(compliance_rate)')} AS average_rate,
  CAST(sum(incident_count) AS BIGINT) AS total_incidents FROM shown""", COMPLIANCE)
DELAYS = """c AS (SELECT carer_id, avg(delay_days) AS avg_delay, count(delay_days) AS incident_count, median(delay_days) AS median_delay,
  max(delay_days) AS max_delay FROM d GROUP BY 1),
shown AS (SELECT * FROM c WHERE incident_count >= 4 ORDER BY avg_delay DESC, carer_id LIMIT 40)"""
DELAY_COLUMNS = f"""carer_id, {r6('avg_delay')} AS avg_delay, incident_count, {r6('median_delay')} AS median_delay, max_delay,
  {DELAY_BAND.format(v='avg_delay')} AS band"""
over_derived("a14_delay_by_carer", f"SELECT {DELAY_COLUMNS} FROM shown", DELAYS)
over_derived("a14_delay_summary", f"""SELECT count(*) FILTER (WHERE avg_delay <= 1) AS excellent, count(*) FILTER (WHERE avg_delay > 2) AS needs_attention,
  count(*) FILTER (WHERE avg_delay > 3) AS poor, {r6('avg(avg_delay)')} AS average_delay FROM shown""", DELAYS)
over_derived("t1_t3_worst_delays", f"""SELECT {DELAY_COLUMNS} FROM (SELECT * FROM c WHERE incident_count >= 10 AND avg_delay > 1
  ORDER BY avg_delay DESC, carer_id LIMIT 15)""", DELAYS)
over_derived("a15_delay_by_date", f"""SELECT {day('incident_date')} AS incident_date, {r6('avg(report_delay_hours)')} AS report_delay_hours FROM d
  WHERE report_delay_hours IS NOT NULL GROUP BY 1""")
STAGE_CELLS = """count(d.incident_id) AS "All_Incidents", count(*) FILTER (WHERE investigation_required) AS "Required_Investigation",
  count(*) FILTER (WHERE investigation_required AND NOT action_complete) AS "Under_Investigation",
  count(*) FILTER (WHERE action_complete) AS "Action_Complete", count(*) FILTER (WHERE NOT action_complete AND {late}) AS "Overdue_Actions",
  count(*) FILTER (WHERE NOT {prompt}) AS "Compliance_Breach" """
BY_FRAME = STAGE_CELLS.format(late=f"NOT {PROMPT_FRAME}", prompt=PROMPT_FRAME)
over_derived("a16_stages_by_carer", f"SELECT carer_id, {BY_FRAME} FROM d GROUP BY 1")
over_derived("a16_stages_by_severity", f"SELECT severity, {BY_FRAME} FROM d GROUP BY 1")
over_derived("a16_stages_by_dates", f"SELECT incident_type, {STAGE_CELLS.format(late='over_24h', prompt='within_24h')} FROM d GROUP BY 1")
over_derived("v2_stages_long", f"""UNPIVOT (SELECT location, {BY_FRAME} FROM d GROUP BY 1) ON {', '.join(f'"{s}"' for s in fixed.STAGES)}
  INTO NAME stage VALUE count""")


def factor(value: str) -> str:
    low = f"lower(trim({value}))"
    buckets = " ".join(f"WHEN regexp_matches({low}, {text(p)}) THEN {text(label)}" for p, label in fixed.FACTOR_PATTERNS)
    stop = ", ".join(text(word) for word in fixed.FACTOR_STOP_WORDS)
    tokens = f"list_filter(regexp_extract_all({low}, '[a-z0-9\\-]+'), lambda t: t NOT IN ({stop}))[1:2]"
    words = f"array_to_string(list_transform({tokens}, lambda t: {title('t').replace('lambda p', 'lambda q').replace('p[', 'q[')}), ' ')"
    fallback = f"CASE WHEN len({tokens}) = 0 THEN 'Other' ELSE {words} END"
    phrase = cases(low, fixed.FACTOR_PHRASES, f"CASE {buckets} ELSE {fallback} END")
    return f"CASE WHEN {value} IS NULL OR trim({value}) = '' THEN 'Unknown' ELSE {phrase} END"


over_derived("a17_factors_by_month", """SELECT t.factor, m.month, count(f.factor) AS count FROM (SELECT factor FROM f GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 25) t
  CROSS JOIN (SELECT DISTINCT month FROM f) m LEFT JOIN f ON f.factor = t.factor AND f.month = m.month GROUP BY 1, 2""",
  f"f AS (SELECT {factor('contributing_factors')} AS factor, month_label AS month FROM d)")
over_derived("a18_monthly_counts", f"""SELECT {day('m')} AS month, count(k.incident_id) AS incidents FROM (SELECT unnest(generate_series(min(month),
  max(month), INTERVAL 1 MONTH)) AS m FROM k) LEFT JOIN k ON k.month = m GROUP BY 1""",
  "k AS (SELECT * FROM d)")
over_derived("a19_weekday_hour", "SELECT day_of_week, " + ", ".join(f"count(*) FILTER (WHERE hour = {h}) AS h{h:02d}" for h in range(24))
             + " FROM d GROUP BY 1")
over_derived("a20_monthly_by_type", f"""SELECT {day("date_trunc('month', incident_datetime)")} AS month,
  CASE WHEN incident_type IN (FROM top) THEN incident_type ELSE 'Other' END AS category, count(*) AS count FROM d GROUP BY 1, 2""",
  "top AS (SELECT incident_type FROM d GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)")
over_derived("a20_monthly_by_factor", f"""SELECT {day("date_trunc('month', incident_datetime)")} AS month,
  CASE WHEN v IN (FROM top) THEN v ELSE 'Other' END AS category, count(*) AS count FROM e GROUP BY 1, 2""",
  "e AS (SELECT *, coalesce(contributing_factors, 'Unknown') AS v FROM d)", "top AS (SELECT v FROM e GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)")
PROFILE = f"count(*) AS incidents, {r6('avg(CAST(severity_numeric >= 3 AS INT))')} AS high_crit_rate, {r6('avg(medical_bin)')} AS medical_rate"
over_derived("a21_type_profile", f"SELECT incident_type, {PROFILE} FROM d GROUP BY 1")
over_derived("a21_location_profile", f"SELECT location, {PROFILE} FROM d GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
TIMELINE = f"incident_id, {stamp('incident_date')} AS incident_date, severity, severity_numeric, location"
over_derived("a23_journey", f"SELECT {TIMELINE} FROM d WHERE participant_id = '370'")
over_derived("a23_journeys", f"""SELECT participant_id, row_number() OVER (PARTITION BY participant_id ORDER BY d.incident_date, incident_id) AS step,
  count(*) OVER (PARTITION BY participant_id) AS steps, {TIMELINE} FROM d""")
over_derived("a23_journey_locations", "SELECT participant_id, location, count(*) AS count FROM d GROUP BY 1, 2")
NAMES = ["participant_age", "severity_numeric", "reportable_bin", "hour", "report_delay_hours"]
over_derived("a24_correlations", " UNION ALL ".join(
    f"SELECT '{a.replace('_', ' ').title()}' AS feature_a, '{b.replace('_', ' ').title()}' AS feature_b, "
    f"{r6(f'coalesce(corr({a}, {b}), 0)')} AS correlation FROM d" for a in NAMES for b in NAMES))
over_derived("a25_leakage_screen", f"""SELECT 'shadow' AS feature, {r6('abs(corr(CAST(reportable AS INT) * 2 + CASE WHEN incident_id % 20 = 0 THEN 1 ELSE 0 END, CAST(reportable AS INT)))')}
  AS correlation FROM d""")
over_derived("a25_target_distribution", "SELECT reportable_bin, count(*) AS count FROM d GROUP BY 1")
over_derived("a26_largest_histories", """SELECT (SELECT max(n) FROM (SELECT count(*) AS n FROM d GROUP BY participant_id)) AS max_participant_incidents,
  (SELECT max(n) FROM (SELECT count(*) AS n FROM d GROUP BY carer_id)) AS max_carer_incidents""")
over_derived("a26_locations_by_count", f"SELECT location, count(*) AS incidents, {r6('avg(severity_numeric)')} AS location_risk FROM d GROUP BY 1")
POINTS = f"""placed AS (SELECT *, {SUBURB} AS suburb, latitude IS NOT NULL AND longitude IS NOT NULL AS given FROM d),
m AS (SELECT placed.*, c.lat AS c_lat, c.lon AS c_lon FROM placed LEFT JOIN centroids c USING (suburb)),
points AS (SELECT *,
  CASE WHEN given THEN latitude WHEN c_lat IS NOT NULL THEN c_lat + (2 * u0 - 1) * (250.0 / 111000.0) END AS point_lat,
  CASE WHEN given THEN longitude WHEN c_lon IS NOT NULL THEN c_lon + (2 * u1 - 1) * (250.0 / (111000.0 * greatest(0.2, cos(radians(c_lat))))) END AS point_lon
  FROM (SELECT *, CAST(('0x' || substr(md5(address), 1, 8)) AS BIGINT) / 4294967296.0 AS u0,
    CAST(('0x' || substr(md5(address), 17, 8)) AS BIGINT) / 4294967296.0 AS u1 FROM m))"""
over_derived("a27_map_kpis", f"""SELECT count(*) AS incidents_shown, count(*) FILTER (WHERE severity = 'Critical') AS critical_incidents,
  (SELECT upper(s[1]) || lower(s[2:]) FROM (SELECT suburb AS s FROM points WHERE point_lat IS NOT NULL AND suburb IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS top_suburb,
  {r6('median(point_lat)')} AS center_lat, {r6('median(point_lon)')} AS center_lon
  FROM points WHERE point_lat IS NOT NULL""", CENTROIDS, POINTS)
over_derived("g3_coordinates", f"SELECT incident_id, {r6('point_lat')} AS latitude, {r6('point_lon')} AS longitude FROM points", CENTROIDS, POINTS)
over_derived("g3_location_names", f"""SELECT incident_id, {r6("coalesce(point_lat, CASE WHEN NOT given THEN CASE incident_id % 3 WHEN 0 THEN -33.8688 WHEN 1 THEN -33.7510 END END)")} AS latitude,
  {r6("coalesce(point_lon, CASE WHEN NOT given THEN CASE incident_id % 3 WHEN 0 THEN 151.2093 WHEN 1 THEN 150.6920 END END)")} AS longitude FROM points""",
  "moved AS (SELECT * REPLACE (CASE WHEN incident_id % 2 = 0 THEN address END AS address) FROM d)", CENTROIDS, POINTS.replace("AS given FROM d)", "AS given FROM moved)"))
CELLS = """cells AS (SELECT CAST(floor(point_lat / 0.01) AS BIGINT) AS cell_lat, CAST(floor(point_lon / 0.01) AS BIGINT) AS cell_lon,
  CAST(sum(CASE severity WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 ELSE 3 END) AS BIGINT) AS weight, count(*) AS incidents
  FROM points WHERE point_lat IS NOT NULL AND point_lon IS NOT NULL GROUP BY 1, 2)"""
over_derived("g5_density", "SELECT * FROM cells", CENTROIDS, POINTS, CELLS)
over_derived("g5_hotspots", "SELECT * FROM cells ORDER BY weight DESC, incidents DESC, cell_lat, cell_lon LIMIT 10", CENTROIDS, POINTS, CELLS)
over_derived("a28_monthly_trend", f"""SELECT {day('month')} AS month, incidents, previous,
  {r6('CASE WHEN previous = 0 THEN 0 ELSE abs(incidents - previous) * 100.0 / previous END')} AS change_pct,
  CASE WHEN previous IS NULL THEN NULL WHEN previous = 0 OR incidents = previous THEN 'flat' WHEN incidents > previous THEN 'up' ELSE 'down' END AS direction
  FROM (SELECT month, count(*) AS incidents, lag(count(*)) OVER (ORDER BY month) AS previous FROM d GROUP BY 1)""")

# --- windows -----------------------------------------------------------------------------------------------------------
HISTORY = """row_number() OVER (PARTITION BY participant_id ORDER BY incident_datetime, incident_id) - 1 AS participant_prior_incidents,
  row_number() OVER (PARTITION BY carer_id ORDER BY incident_datetime, incident_id) - 1 AS carer_prior_incidents"""
TOTALS = """count(*) OVER (PARTITION BY participant_id) AS participant_total_incidents,
  count(*) OVER (PARTITION BY carer_id) AS carer_total_incidents"""
over_derived("w1_w2_histories", f"SELECT incident_id, {HISTORY}, {TOTALS} FROM d")
over_derived("w3_fallback_features", f"""SELECT incident_id, CAST(hour AS DOUBLE) AS hour, CAST(is_weekend AS DOUBLE) AS is_weekend,
  CAST(is_kitchen AS DOUBLE) AS is_kitchen, CAST(is_bathroom AS DOUBLE) AS is_bathroom,
  CAST(participant_prior_incidents AS DOUBLE) AS participant_incident_count, CAST(carer_prior_incidents AS DOUBLE) AS carer_incident_count,
  3.0::DOUBLE * is_kitchen + 3.0::DOUBLE * is_bathroom + 1.0::DOUBLE AS location_risk_score FROM (SELECT *, {HISTORY} FROM d)""")


def cooldown(keys: str, micros: int) -> str:
    return f"""WITH RECURSIVE e AS (SELECT event_id, {keys} AS k, epoch_us(ts) AS us,
    row_number() OVER (PARTITION BY {keys} ORDER BY ts, event_id) AS n FROM events),
  walk AS (SELECT event_id, k, n, true AS allowed, us AS last FROM e WHERE n = 1 UNION ALL
    SELECT e.event_id, e.k, e.n, e.us - w.last >= {micros}, CASE WHEN e.us - w.last >= {micros} THEN e.us ELSE w.last END
    FROM walk w JOIN e ON e.k = w.k AND e.n = w.n + 1)"""


ORACLES["w7_cooldown"] = cooldown("user_id || event_type", 86_400_000_000) + " SELECT event_id, CAST(allowed AS INT) AS allowed FROM walk"
ORACLES["w7_cooldown_per_type"] = cooldown("event_type", 3_600_000_000) + " SELECT event_id, CAST(allowed AS INT) AS allowed FROM walk"
ORACLES["st2_st3_s6_stream_outbox"] = cooldown("user_id || event_type", 86_400_000_000) + f"""
  SELECT event_id AS alert_id, {stamp('ts')} AS event_time FROM walk JOIN events USING (event_id) WHERE allowed"""

# --- text --------------------------------------------------------------------------------------------------------------
over_incidents("x1_factor_labels", f"SELECT incident_id, {factor('contributing_factors')} AS factor FROM incidents")
ORACLES["x1_document_labels"] = f"SELECT {factor('text')} AS factor, count(*) AS count FROM documents GROUP BY 1"
over_incidents("x1b_simple_labels", """SELECT incident_id, substr(CASE WHEN split_part(s, ';', 1) = '' THEN s ELSE split_part(s, ';', 1) END, 1, 30) AS factor
  FROM (SELECT incident_id, concat_ws(';', contributing_factors, location) AS s FROM incidents)""")
SUMMARY = f"""'On ' || {day('incident_date')} || ' at ' || trim(location) || ', a ' || {title('trim(incident_type)')} || ' occurred (severity: ' || severity || ')'
  || coalesce(', notified after ' || delay_days || ' day(s)', '') || '. Carer ' || carer_id"""
over_derived("x2_summaries", f"""SELECT incident_id, {SUMMARY} || {text(fixed.SUMMARY_CLOSING['basic'])} AS summary,
  {SUMMARY} || {text(fixed.SUMMARY_CLOSING['extended'])} AS summary_extended FROM d""")


def mitigations(rules: str) -> str:
    lines = fixed.MITIGATIONS[rules]
    severe = "severity IN ('High', 'Critical')"
    arms = [("delay_days > 1", "late"), ("contains(lower(incident_type), 'self') OR contains(lower(incident_type), 'harm')", "self_harm"),
            ("contains(lower(incident_type), 'medication')", "medication"), ("contains(lower(incident_type), 'fall')", "fall"), (severe, "severe")]
    parts = ", ".join(f"CASE WHEN {condition} THEN {text(lines[key])} END" for condition, key in arms)
    return f"coalesce(nullif(concat_ws(' | ', {parts}), ''), {text(lines['default'])})"


over_derived("x3_mitigations", f"SELECT incident_id, {mitigations('basic')} AS basic, {mitigations('extended')} AS extended FROM d")
over_derived("u2_distinct_lines", f"SELECT incident_id, {mitigations('basic')} AS lines FROM d")
over_derived("x4_prompts", f"""SELECT incident_id, {text(fixed.PROMPT_HEAD)} || coalesce(contributing_factors, '') || {text(fixed.PROMPT_CONTEXT)} ||
  '{{"incident_id":' || incident_id || ',"incident_type":"' || incident_type || '","severity":"' || severity || '","location":"' || location || '"}}'
  || {text(fixed.PROMPT_TASKS)} AS prompt FROM d""")
over_derived("x5_alert_messages", f"""SELECT incident_id, reason AS alert_reason, '[NDIS Early Alert] Incident ' || incident_id || ' flagged (' || reason
  || '). Severity: ' || severity || ' | Location: ' || location || ' | Date: ' || {day('incident_date')} || '. Please review and escalate per SOP.'
  AS alert_message FROM (SELECT *, {REASON} AS reason FROM d)""")
SITUATIONS = """situation(scenario, severity, hour, location, day_type, participant_history, carer_history, location_risk) AS (VALUES
  ('Early Morning Kitchen Risk', 'HIGH', 6, 'kitchen', 'weekday', 3, 5, 3), ('High-Risk Combination', 'MEDIUM', 8, '', 'weekday', 5, 10, 1),
  ('Weekend Transport Risk', 'MEDIUM', 8, 'transport', 'weekend', 3, 5, 2)),
rated AS (SELECT s.*, avg(CAST(d.severity_numeric >= 3 AS INT)) AS score FROM situation s JOIN d ON contains(lower(d.location), s.location)
  AND abs(d.hour - s.hour) <= 2 GROUP BY ALL)"""
RECOMMENDED = cases("scenario", [(k, " | ".join(v)) for k, v in fixed.SCENARIO_RECOMMENDATIONS.items()], "'?'")
over_derived("x6_recommendations", f"SELECT scenario, {RECOMMENDED} AS recommendation FROM rated", SITUATIONS)
over_derived("ml11_situation_alerts", f"""SELECT scenario, severity, hour, location, day_type, participant_history, carer_history, location_risk,
  {r6('score')} AS risk_score, {RISK_BAND.format(v='score')} AS risk_level, CAST(threshold AS DOUBLE) AS threshold, {RECOMMENDED} AS recommendation
  FROM (SELECT *, CASE severity WHEN 'HIGH' THEN 0.2 ELSE 0.3 END AS threshold FROM rated) WHERE score > threshold""", SITUATIONS)

# --- places ------------------------------------------------------------------------------------------------------------
over_incidents("g1_suburbs", f"SELECT incident_id, {SUBURB} AS suburb, nullif(regexp_extract(address, '{SUBURB_RE}', 2), '') AS postcode FROM incidents")
over_incidents("g2_jitter", f"""SELECT incident_id, {r6("coalesce((2 * (CAST(('0x' || substr(md5(address), 1, 8)) AS BIGINT) / 4294967296.0) - 1) * (250.0 / 111000.0), 0)")} AS shift_lat,
  {r6("coalesce((2 * (CAST(('0x' || substr(md5(address), 17, 8)) AS BIGINT) / 4294967296.0) - 1) * (250.0 / (111000.0 * greatest(0.2, cos(radians(-33.8915))))), 0)")} AS shift_lon FROM incidents""")
PLACES = "places(location, lat, lon) AS (VALUES " + ", ".join(
    f"({text(n)}, CAST({a} AS DOUBLE), CAST({o} AS DOUBLE))" for n, a, o in fixed.NAMED_PLACES) + ")"
over_derived("g4_place_points", rf"""SELECT incident_id,
  {r6("coalesce(p.lat, CASE WHEN street THEN -33.95 + (CAST(('0x' || substr(md5(location), 1, 8)) AS BIGINT) / 4294967296.0) * (-33.84 - -33.95) END)")} AS lat,
  {r6("coalesce(p.lon, CASE WHEN street THEN 151.10 + (CAST(('0x' || substr(md5(location), 17, 8)) AS BIGINT) / 4294967296.0) * (151.26 - 151.10) END)")} AS lon
  FROM (SELECT *, coalesce(regexp_matches(location, '\d+ [\w ]+, [\w ]+ NSW \d+'), false) AS street FROM (SELECT incident_id,
    CASE WHEN incident_id % 2 = 0 THEN location ELSE replace(address, ', NSW', ' NSW') END AS location FROM d)) LEFT JOIN places p USING (location)""", PLACES)
over_derived("s5_geocoded_csv", f"""SELECT incident_id, location, {r6('p.lat')} AS lat, {r6('p.lon')} AS lon
  FROM d LEFT JOIN places p USING (location)""", PLACES)
over_incidents("g6_geocode_requests", "SELECT DISTINCT address FROM incidents WHERE regexp_matches(address, '[0-9]') AND contains(address, ',')")

# --- forecasts ---------------------------------------------------------------------------------------------------------


def forecast_sql(where: str, horizon: int, group: str | None = None, source: str = "incidents", log: bool = False, flat: bool = False) -> tuple:
    g = group or "'all'"
    value = "ln(1 + greatest(n, 0.1))" if log else "CAST(n AS DOUBLE)"
    parts = [
        f"base AS (SELECT {g} AS g, date_trunc('month', incident_date) AS m FROM {source} WHERE {where})",
        """months AS (SELECT g, unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH)) AS m FROM base GROUP BY g)""",
        """monthly AS (SELECT months.g, months.m, count(base.m) AS n FROM months LEFT JOIN base ON base.g = months.g AND base.m = months.m GROUP BY 1, 2)""",
        f"""y AS (SELECT g, m, n, {value} AS v, row_number() OVER (PARTITION BY g ORDER BY m) AS i,
            row_number() OVER (PARTITION BY g ORDER BY m DESC) AS back FROM monthly)""",
        """f AS (SELECT g, max(m) AS last_month, count(*) AS len, avg(v) AS mean, stddev_samp(v) AS sd, max(n) AS top,
            max(v) FILTER (WHERE back = 1) AS v1, max(v) FILTER (WHERE back = 3) AS v3,
            avg(v) FILTER (WHERE back <= 12) AS recent, avg(v) FILTER (WHERE back BETWEEN 13 AND 24) AS older FROM y GROUP BY g)""",
        """t AS (SELECT *, CASE WHEN len < 24 THEN 0.0 WHEN older = 0 THEN 0.1 ELSE greatest(-0.1, least(0.1, (recent - older) / older)) END AS change,
            greatest(-0.1 * v1, least(0.1 * v1, (v1 - v3) / 2)) AS slope FROM f)""",
    ]
    point = "greatest(0.1, v1)" if flat else (
        "CASE WHEN len < 3 THEN mean WHEN len >= 12 THEN (SELECT y.v FROM y WHERE y.g = t.g AND y.i = len - 12 + 1 + (h - 1) % 12) * (1 + change) "
        "ELSE greatest(0.1, v1 + slope * h) END")
    level, reach0 = ("true", "greatest(0.1, v1)") if flat else ("len < 3", "mean")
    parts.append(f"""p AS (SELECT g, last_month, h, top, {point} AS point,
      1.96 * CASE WHEN sd IS NULL THEN NULL WHEN {level} THEN greatest(sd, sqrt({reach0})) ELSE sd * sqrt(h) END AS reach
      FROM t, range(1, {horizon + 1}) r(h))""")
    if log:
        shown = ("least(exp(point) - 1, top * 3)", "greatest(0, exp(point - reach) - 1)", "least(exp(point + reach) - 1, top * 4)")
    else:
        shown = ("point", "CASE WHEN reach IS NOT NULL THEN greatest(0, point - reach) END", "point + reach")
    name = f"coalesce(y.g, q.g) AS {group}, " if group else ""
    body = f"""SELECT {name}{day('coalesce(y.m, q.date)')} AS date, CAST(y.n AS DOUBLE) AS actual, {r6('q.point')} AS forecast, {r6('q.low')} AS lower, {r6('q.high')} AS upper
      FROM y FULL JOIN (SELECT g, last_month + to_months(CAST(h AS INT)) AS date, {shown[0]} AS point, {shown[1]} AS low, {shown[2]} AS high FROM p) q
      ON y.g = q.g AND y.m = q.date"""
    return body, *parts


over_incidents("m1_forecast", *forecast_sql("true", 6))
over_incidents("w5_seasonal_change", *forecast_sql("true", 14))
over_incidents("j5_actual_and_forecast", *forecast_sql("true", 8, "participant_id"))
over_derived("m1_forecast_by_location", *forecast_sql("true", 6, "location", "d"))
over_incidents("m1_forecast_line", *forecast_sql("true", 6, "participant_id"))
over_incidents("m1_forecast_mean", *forecast_sql(
    "true", 6, "pair", "(SELECT incident_date, concat_ws('/', participant_id, incident_type) AS pair FROM incidents)"))
over_incidents("m1_forecast_flat", *forecast_sql("true", 6, "carer_id", flat=True))
over_incidents("m2_forecast_log", *forecast_sql("true", 6, "carer_id", log=True))

# --- decomposition -----------------------------------------------------------------------------------------------------


def additive_sql(group: str, source: str) -> str:
    """Monthly actual, trend, season and rest by group ``g``."""
    return f"""m AS (SELECT {group} AS g, date_trunc('month', incident_date) AS month, CAST(count(*) AS DOUBLE) AS n FROM {source} WHERE incident_date IS NOT NULL GROUP BY ALL),
lim AS (SELECT g, min(month) AS lo, max(month) AS hi FROM m GROUP BY g),
ser AS (SELECT s.g, s.month, coalesce(m.n, 0) AS y, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY s.g) AS len
  FROM (SELECT g, unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS month FROM lim) s LEFT JOIN m ON m.g IS NOT DISTINCT FROM s.g AND m.month = s.month
  WINDOW w AS (PARTITION BY s.g ORDER BY s.month)),
tr AS (SELECT *, CASE WHEN len >= 24 AND i >= 6 AND i < len - 6 THEN
  (sum(y) OVER (PARTITION BY g ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)
   + (lag(y, 6) OVER (PARTITION BY g ORDER BY i) + lead(y, 6) OVER (PARTITION BY g ORDER BY i)) / 2) / 12 END AS trend FROM ser),
raws AS (SELECT g, i % 12 AS place, avg(y - trend) AS share FROM tr GROUP BY ALL),
ssn AS (SELECT g, place, share - avg(share) OVER (PARTITION BY g) AS season FROM raws),
dec AS (SELECT tr.g, tr.month, tr.i, y AS actual, trend, season, y - trend - season AS rest FROM tr JOIN ssn ON ssn.g IS NOT DISTINCT FROM tr.g AND ssn.place = tr.i % 12)"""


for _name, _group, _source, _over in (
    ("d1_additive", None, "incidents", over_incidents),
    ("d1_additive_by_location", "location", "d", over_derived),
    ("d1_additive_short_series", "participant_id", "incidents", over_incidents),
):
    _over(_name, f"""SELECT {f'g AS {_group}, ' if _group else ''}{day('month')} AS month, {r6('actual')} AS actual, {r6('trend + 1e-9')} AS trend, {r6('season + 1e-9')} AS season,
  {r6('rest + 1e-9')} AS rest FROM dec""", additive_sql(_group or "true", _source))
over_derived("d3_portmanteau_of_rests", f"""SELECT g AS location, CAST(len AS INT) AS n, {r6('len * (len + 2) * sum(r * r / (len - k))')} AS q FROM (
  SELECT a.g, k, a.len, sum(a.o * b.o) / any_value(a.sq) AS r FROM o2 a JOIN (SELECT unnest(range(1, 13)) AS k) ON true JOIN o2 b ON a.g IS NOT DISTINCT FROM b.g AND b.p = a.p + k
  GROUP BY a.g, k, a.len) GROUP BY g, len""", additive_sql("location", "d"),
    """o1 AS (SELECT g, rest - avg(rest) OVER (PARTITION BY g) AS o, row_number() OVER (PARTITION BY g ORDER BY i) AS p, count(*) OVER (PARTITION BY g) AS len FROM dec WHERE rest IS NOT NULL),
o2 AS (SELECT *, sum(o * o) OVER (PARTITION BY g) AS sq FROM o1)""")

# --- models ------------------------------------------------------------------------------------------------------------
RISK = "avg(severity_numeric) OVER (PARTITION BY location)"
over_derived("ml1_prepared", f"""SELECT incident_id, {stamp('incident_datetime')} AS incident_datetime, incident_weekday, severity, severity_numeric, location,
  medical_bin AS medical_attention_required_bin, reportable_bin, hour, day_of_week, is_weekend,
  CASE WHEN is_weekend = 1 THEN 'weekend' ELSE 'weekday' END AS day_type, {HISTORY}, {TOTALS}, {r6(RISK)} AS location_risk_score,
  is_kitchen, is_bathroom, CAST(investigation_required AS INT) AS investigation_required, CAST(action_complete AS INT) AS action_complete FROM d""")
FEATURES = f"""incident_id, CAST(hour AS DOUBLE) AS hour, CAST(is_weekend AS DOUBLE) AS is_weekend, CAST(is_kitchen AS DOUBLE) AS is_kitchen,
  CAST(is_bathroom AS DOUBLE) AS is_bathroom, CAST(participant_prior_incidents AS DOUBLE) AS participant_incident_count,
  CAST(carer_prior_incidents AS DOUBLE) AS carer_incident_count, {r6('risk')} AS location_risk_score, CAST(severity_numeric AS DOUBLE) AS severity_numeric"""
over_derived("ml2_features", f"SELECT {FEATURES} FROM (SELECT *, {HISTORY}, {RISK} AS risk FROM d)")
over_derived("j9_feature_columns", f"""SELECT f.*, array_to_string(list_sort(list_filter([CASE WHEN l.location IS NOT NULL THEN 'loc__' || f2.location END,
    CASE WHEN t.incident_type IS NOT NULL THEN 'type__' || f2.incident_type END], lambda x: x IS NOT NULL)), ' | ') AS hot,
  CAST((SELECT count(*) FROM top_l) + (SELECT count(*) FROM top_t) - CAST(l.location IS NOT NULL AS INT) - CAST(t.incident_type IS NOT NULL AS INT) AS INT) AS zeros
  FROM (SELECT {FEATURES} FROM (SELECT *, {HISTORY}, {RISK} AS risk FROM d)) f JOIN d f2 USING (incident_id)
  LEFT JOIN top_l l ON l.location = f2.location LEFT JOIN top_t t ON t.incident_type = f2.incident_type""",
  "top_l AS (SELECT location FROM d WHERE location IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, location LIMIT 10)",
  "top_t AS (SELECT incident_type FROM d WHERE incident_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, incident_type LIMIT 10)")
over_derived("x4_model_summaries", f"""SELECT incident_id, length({text(fixed.PROMPT_HEAD)} || {text(fixed.PROMPT_CONTEXT)} ||
  '{{"incident_id":' || incident_id || ',"incident_type":"' || incident_type || '","severity":"' || severity || '","location":"' || location || '"}}'
  || {text(fixed.PROMPT_TASKS)}) || ' characters read' AS summary, {mitigations('basic')} AS mitigations FROM d""")
MODELS = "(VALUES ('RandomForest'), ('LogisticRegression')) m(model)"
over_derived("ml7_ml9_prediction_facts", f"""SELECT model, count(*) AS rows, count(DISTINCT incident_id) AS ids,
  CAST(sum(CAST(severity_numeric >= 3 AS INT)) AS BIGINT) AS positives, count(*) AS cells, CAST(0 AS BIGINT) AS bad_scores, CAST(0 AS BIGINT) AS wrong_sides
  FROM d, {MODELS} WHERE epoch_us(incident_datetime) > (SELECT quantile_cont(epoch_us(incident_datetime), 0.75) FROM d) GROUP BY model""")
ORACLES["ml8_fold_facts"] = f"""SELECT model, 1 AS accuracy_ok, 1 AS mean_ok, 1 AS deviation_ok, 1 AS features_ok, 1 AS suspicious_ok, 1 AS overfitted_ok FROM {MODELS}"""
over_derived("ml10_score_facts", "SELECT count(*) AS rows, count(*) AS ids, CAST(0 AS BIGINT) AS bad_scores, CAST(0 AS BIGINT) AS overlaps FROM d")
ORACLES["t4_e3_ranking_facts"] = f"SELECT model, 1 AS sorted, 1 AS positive, 1 AS complete FROM {MODELS}"
over_derived("ml10_ml11_trained_alerts", f"""SELECT scenario, severity, hour, location, CAST(0.5 AS DOUBLE) AS threshold, 'RandomForest' AS model_used,
  {RECOMMENDED} AS recommendation FROM situation WHERE hour BETWEEN 5 AND 7""", SITUATIONS)
FACTS = "count(*) AS rows, count(*) AS ids, CAST({k} AS BIGINT) AS clusters, 1 AS centred, 1 AS apart, 1 AS in_order"
over_derived("cl1_cluster_facts", f"SELECT {FACTS.format(k=4)} FROM d")
over_derived("cl2_cluster_facts", f"SELECT {FACTS.format(k=4)} FROM d")
ORACLES["cl1_embedding_cluster_facts"] = f"SELECT {FACTS.format(k=10)} FROM embeddings"
over_derived("v3_one_hot", """SELECT incident_id, CAST(location = 'Unknown' AS INT)::DOUBLE AS "loc__Unknown",
  CAST(incident_type = 'Fall' AS INT)::DOUBLE AS "type__Fall" FROM d""")
over_derived("ml3_guard_report", f"""SELECT feature, category, reason, {r6('value')} AS value, CAST(category IS NULL AS INT) AS kept FROM (
  SELECT 'hour' AS feature, NULL AS category, NULL AS reason, abs(corr(hour, y)) AS value FROM l UNION ALL
  SELECT 'is_weekend', NULL, NULL, abs(corr(is_weekend, y)) FROM l UNION ALL SELECT 'is_kitchen', NULL, NULL, abs(corr(is_kitchen, y)) FROM l UNION ALL
  SELECT 'participant_age', NULL, NULL, abs(corr(participant_age, y)) FROM l UNION ALL
  SELECT 'report_delay_hours', 'pattern_drops', 'report', NULL UNION ALL
  SELECT 'incident_id', 'unique_ratio_drops', NULL, count(DISTINCT incident_id) / count(*) FROM l UNION ALL
  SELECT 'severity_numeric', 'pattern_drops', 'severity', NULL UNION ALL
  SELECT 'label_copy', 'correlation_drops', NULL, abs(corr(y, y)) FROM l)""", "l AS (SELECT *, CAST(severity_numeric >= 3 AS INT) AS y FROM d)")
LABELS = "l AS (SELECT *, CAST(severity_numeric >= 3 AS INT) AS label FROM d)"
over_derived("ml4_target", "SELECT label, count(*) AS count FROM l GROUP BY 1", LABELS)
over_derived("ml5_time_split", f"""SELECT CAST(us > cut AS INT) AS is_test, count(*) AS count, {stamp('min(incident_datetime)')} AS first,
  {stamp('max(incident_datetime)')} AS last FROM (SELECT incident_datetime, CAST(epoch_us(incident_datetime) AS DOUBLE) AS us,
  quantile_cont(CAST(epoch_us(incident_datetime) AS DOUBLE), 0.75) OVER () AS cut FROM d) GROUP BY 1""")
over_derived("ml5_stratified_split", """SELECT label, s AS is_test, CAST(CASE s WHEN 1 THEN round(n * 0.25) ELSE n - round(n * 0.25) END AS BIGINT) AS count
  FROM (SELECT label, count(*) AS n FROM l GROUP BY 1), (VALUES (0), (1)) v(s)""", LABELS)
over_derived("ml5_group_split", """SELECT s AS is_test, CAST(CASE s WHEN 1 THEN ceil(n * 0.25) ELSE n - ceil(n * 0.25) END AS BIGINT) AS participants
  FROM (SELECT count(DISTINCT participant_id) AS n FROM d), (VALUES (0), (1)) v(s)""")
over_derived("ml8_folds", """SELECT label, CAST(f AS INT) AS fold, (n - f + 2) // 3 AS count FROM (SELECT label, count(*) AS n FROM l GROUP BY 1), range(3) r(f)""", LABELS)
SCORED = """scored AS (SELECT incident_id, label, (incident_id * 37 % 700 + label * 300) / 1000.0 AS p FROM l),
q AS (SELECT *, CAST(p > 0.5 AS INT) AS pred FROM scored)"""
over_derived("e1_confusion_matrix", "SELECT label, pred AS prediction, count(*) AS count FROM q GROUP BY 1, 2", LABELS, SCORED)
over_derived("e1_class_metrics", f"""SELECT c AS class, {r6('coalesce(tp / nullif(predicted, 0), 0)')} AS precision, {r6('coalesce(tp / nullif(support, 0), 0)')} AS recall,
  {r6('coalesce(2 * tp / nullif(predicted + support, 0), 0)')} AS f1, support FROM (SELECT c, count(*) FILTER (WHERE label = c AND pred = c) AS tp,
  count(*) FILTER (WHERE pred = c) AS predicted, count(*) FILTER (WHERE label = c) AS support FROM q, (VALUES (0), (1)) v(c) GROUP BY c)""", LABELS, SCORED)
STEPS = """s AS (SELECT p, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg FROM q GROUP BY p),
r AS (SELECT p, pos, neg, CAST(sum(pos) OVER (ORDER BY p DESC) AS BIGINT) AS tp, CAST(sum(neg) OVER (ORDER BY p DESC) AS BIGINT) AS fp,
  CAST(sum(pos) OVER () AS BIGINT) AS all_pos, CAST(sum(neg) OVER () AS BIGINT) AS all_neg FROM s)"""
over_derived("w6_score_steps", f"""SELECT {r6('p')} AS probability, pos AS positives, neg AS negatives, tp - pos AS tp_before, fp - neg AS fp_before,
  all_pos AS all_positives, all_neg AS all_negatives FROM r""", LABELS, SCORED, STEPS)
over_derived("e2_roc_points", f"SELECT {r6('p')} AS threshold, {r6('fp / all_neg')} AS fpr, {r6('tp / all_pos')} AS tpr FROM r", LABELS, SCORED, STEPS)
over_derived("e2_precision_recall_points", f"SELECT {r6('p')} AS threshold, {r6('tp / all_pos')} AS recall, {r6('tp / (tp + fp)')} AS precision FROM r",
             LABELS, SCORED, STEPS)
over_derived("e2_curve_areas", f"""SELECT {r6('sum((fpr - fpr0) * (tpr + tpr0) / 2)')} AS roc_auc, {r6('sum((tpr - tpr0) * (pre + pre0) / 2)')} AS pr_auc FROM (
  SELECT fp / all_neg AS fpr, tp / all_pos AS tpr, tp / (tp + fp) AS pre, coalesce(lag(fp / all_neg) OVER o, 0) AS fpr0,
  coalesce(lag(tp / all_pos) OVER o, 0) AS tpr0, coalesce(lag(tp / (tp + fp)) OVER o, 1) AS pre0 FROM r WINDOW o AS (ORDER BY p DESC))""", LABELS, SCORED, STEPS)
# isotonic rates by their definition: the largest, over starts up to a level, of the smallest mean from there to an end from the level on
ISOTONIC = """lv AS (SELECT CAST(round(p * 10000) AS INT) AS low, CAST(incident_id % 5 AS INT) AS own, sum(label) AS h, count(*) AS n FROM scored GROUP BY ALL),
o AS (SELECT f.fold, low, sum(h) AS h, sum(n) AS n FROM lv JOIN (SELECT unnest(range(5))::INT AS fold) f ON f.fold <> own GROUP BY f.fold, low),
cum AS (SELECT fold, low, h, n, row_number() OVER w AS i, sum(h) OVER w AS ch, sum(n) OVER w AS cn FROM o WINDOW w AS (PARTITION BY fold ORDER BY low)),
pr AS (SELECT a.fold, a.i AS a, b.i AS b, (b.ch - a.ch + a.h) / (b.cn - a.cn + a.n) AS mean FROM cum a JOIN cum b ON a.fold = b.fold AND b.i >= a.i),
mn AS (SELECT fold, a, b, min(mean) OVER (PARTITION BY fold, a ORDER BY b DESC) AS m FROM pr),
iso AS (SELECT c.fold, c.low, c.h, c.n, g.rate FROM (SELECT fold, b AS i, max(m) AS rate FROM mn GROUP BY fold, b) g JOIN cum c USING (fold, i)),
bl AS (SELECT fold, min(low) AS low, CAST(sum(h) AS DOUBLE) AS hits, CAST(sum(n) AS DOUBLE) AS n, sum(h) / sum(n) AS rate FROM iso GROUP BY fold, round(rate, 9)),
cal AS (SELECT x.incident_id, CAST(x.incident_id % 5 AS INT) AS fold, x.p, x.label, coalesce(
  (SELECT max_by(bl.rate, bl.low) FROM bl WHERE bl.fold = x.incident_id % 5 AND bl.low <= CAST(round(x.p * 10000) AS INT)),
  (SELECT min_by(bl.rate, bl.low) FROM bl WHERE bl.fold = x.incident_id % 5)) AS calibrated FROM scored x)"""


def tenths(table: str, value: str) -> str:
    return f"""SELECT tenth, CAST(sum(n) AS BIGINT) AS rows, {r6('sum(s) / sum(n)')} AS mean_score, {r6('sum(h) / sum(n)')} AS rate, {r6('abs(sum(s) / sum(n) - sum(h) / sum(n))')} AS apart
FROM (SELECT *, CAST(floor((sum(n) OVER (ORDER BY low) - n) * 10 / sum(n) OVER ()) AS INT) AS tenth
  FROM (SELECT round({value} * 10000) AS low, count(*) AS n, sum({value}) AS s, sum(label) AS h FROM {table} GROUP BY 1)) GROUP BY tenth"""


over_derived("e4_isotonic_blocks", f"SELECT fold, low, hits, n, {r6('rate')} AS rate FROM bl", LABELS, SCORED, ISOTONIC)
over_derived("e4_calibrated", f"SELECT incident_id, fold, {r6('p')} AS probability, {r6('calibrated')} AS calibrated FROM cal", LABELS, SCORED, ISOTONIC)
over_derived("e4_reliability", tenths("scored", "p"), LABELS, SCORED)
over_derived("e4_reliability_calibrated", tenths("cal", "calibrated"), LABELS, SCORED, ISOTONIC)
over_derived("q21_exact_percentiles", f"""SELECT {r6('quantile_cont(participant_age, 0.8)')} AS age_p80, {r6('median(participant_age)')} AS age_median,
  {r6('quantile_cont(report_delay_hours, 0.9)')} AS delay_p90 FROM d""")

# --- similarity --------------------------------------------------------------------------------------------------------
VECTORS = """x AS (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
st AS (SELECT i, avg(v) AS m, CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1 END AS s FROM x GROUP BY i),
z AS (SELECT vec_id AS id, any_value(label) AS label, list((v - m) / s ORDER BY i) AS z FROM x JOIN st USING (i) GROUP BY vec_id)"""
NEAREST = """SELECT query_id, id, similarity, rank FROM (SELECT a.id AS query_id, b.id AS id, round(list_cosine_similarity(a.z, b.z), 6) + 0.0 AS similarity,
  row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.z, b.z), 6) DESC, b.id) AS rank
  FROM {queries} a JOIN z b ON a.id <> b.id) WHERE rank <= {k}"""
ORACLES["si1_similar_rows"] = f"WITH {VECTORS} " + NEAREST.format(
    queries="(SELECT * FROM z WHERE id % 20 = 0)", k=5).replace(", rank FROM (SELECT a", ", CAST(rank AS INT) AS rank FROM (SELECT a")
ORACLES["si2_similar_to_all"] = f"WITH {VECTORS} " + NEAREST.format(queries="z", k=3).replace(
    ", rank FROM (SELECT a", ", CAST(rank AS INT) AS rank FROM (SELECT a")
INCIDENT_VECTORS = """n AS (SELECT incident_id AS id, incident_datetime, CAST(hour AS DOUBLE) AS a, CAST(is_weekend AS DOUBLE) AS b, CAST(is_kitchen AS DOUBLE) AS c,
    CAST(is_bathroom AS DOUBLE) AS e, CAST(severity_numeric AS DOUBLE) AS f, coalesce(CAST(participant_age AS DOUBLE), 0) AS g FROM d),
z AS (SELECT id, incident_datetime, [""" + ", ".join(
    f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()" for c in "abcefg") + "] AS z FROM n)"
over_derived("t5_si1_similar_incidents", NEAREST.format(
    queries="(SELECT * FROM z WHERE id % 20 = 0)", k=5).replace(
    ", rank FROM (SELECT a", ", CAST(rank AS INT) AS rank FROM (SELECT a"), INCIDENT_VECTORS)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERMS = f"""w AS (SELECT doc_id, unnest(list_filter(string_split_regex(translate(text, '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS term FROM documents),
c AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
f AS (SELECT term, ln((1 + (SELECT count(DISTINCT doc_id) FROM c)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY term),
v AS (SELECT doc_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS weight FROM c JOIN f USING (term))"""
ORACLES["tx1_term_weights"] = f"WITH {TERMS} SELECT doc_id, count(*) AS terms, round(min(weight), 6) AS least, round(max(weight), 6) AS most FROM v GROUP BY doc_id"
ORACLES["tx1_similar_texts"] = f"""WITH {TERMS},
s AS (SELECT q.doc_id AS query_id, d.doc_id AS id, round(sum(q.weight * d.weight), 6) AS similarity
  FROM v q JOIN v d ON q.term = d.term AND q.doc_id <> d.doc_id WHERE q.doc_id % 20 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s)
SELECT query_id, id, similarity, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5"""

# --- alerts ------------------------------------------------------------------------------------------------------------
ALERTS = f"""a AS (SELECT incident_id, incident_datetime AS moment, {REASON} AS reason, severity, location, incident_date FROM d)"""
CHANNELS = "(VALUES ('sms', 'SMS'), ('email', 'Email')) c(channel, label)"
over_derived("st1_route", f"""SELECT incident_id, reason AS alert_reason, c.channel, {stamp('moment + to_minutes(v.minutes)')} AS incident_datetime,
  CASE WHEN reason IS NULL THEN 'No alert: policy not matched.' WHEN v.sent THEN label || ' queued.' ELSE label || ' skipped: cooldown.' END AS result
  FROM a CROSS JOIN (VALUES (0, true), (0, false), (30, false), (120, true)) v(minutes, sent) LEFT JOIN {CHANNELS} ON reason IS NOT NULL""", ALERTS)
over_derived("st1_st3_route_stream", f"""SELECT incident_id + v.shift AS alert_id, reason, c.channel,
  CASE WHEN reason IS NOT NULL THEN '[NDIS Early Alert] Incident ' || (incident_id + v.shift) || ' flagged (' || reason || '). Severity: ' || severity
    || ' | Location: ' || location || ' | Date: ' || {day('incident_date')} || '. Please review and escalate per SOP.' END AS message,
  {stamp('moment + to_minutes(v.minutes)')} AS event_time,
  CASE WHEN reason IS NULL THEN 'No alert: policy not matched.' WHEN v.sent THEN label || ' queued.' ELSE label || ' skipped: cooldown.' END AS result
  FROM a CROSS JOIN (VALUES (0, 0, true), (0, 0, false), (120, 0, true), (-180, 0, false), (-6000, 1000000000, true)) v(minutes, shift, sent)
  LEFT JOIN {CHANNELS} ON reason IS NOT NULL""", ALERTS)
over_derived("st1_route_without_channels", f"""SELECT CASE WHEN reason IS NULL THEN 'No alert: policy not matched.' ELSE 'No channels configured.' END AS result,
  count(*) AS count FROM (SELECT {REASON} AS reason FROM d) GROUP BY 1""")
