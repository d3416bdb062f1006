"""Hand-made rows for the cases that look right on clean data."""

import re
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from incidentry import fixed_values as fixed
from incidentry.functions import clock, common, grades, places, wording
from incidentry.operators import carers, geography, joins, reports, rules
from incidentry.plans import prepare
from incidentry.sources import incidents as source

DAY = datetime(2024, 3, 4)


def rows(spark, schema, *values):
    return spark.createDataFrame(list(values), schema)


def column(df, name):
    return [row[name] for row in df.collect()]


@pytest.mark.parametrize("text", ["self-harm", "o'NEIL st", "a1b2c", "  two  blanks ", "MIXED case", ""])
def test_title_case_is_capital_after_any_non_letter(spark, text):
    assert rows(spark, "x string", (text,)).select(common.title_case("x").alias("y")).first()["y"] == text.title()


def test_severity_words_and_default(spark):
    df = rows(spark, "s string", (" SEVERE ",), ("Major",), ("moderate",), ("n/a",), (None,))
    assert column(df.select(grades.normal_severity("s").alias("y")), "y") == ["Critical", "High", "Medium", "Medium", "Medium"]


def test_map_severity_keeps_known_names_and_reads_prefixes(spark):
    df = rows(spark, "s string", ("Moderate",), ("CRITICAL!",), ("mod",), ("other",), (None,))
    assert column(df.select(grades.map_severity("s").alias("y")), "y") == ["Moderate", "Critical", "Moderate", "Low", "Low"]


@pytest.mark.parametrize(
    "values, expected",
    [
        (["Yes", "n", " REQUIRED ", None, "maybe"], [1, 0, 1, 0, 0]),
        (["2", "yes", "0", None, "-1"], [1, 0, 0, 0, 0]),  # one number makes the column numeric
    ],
)
def test_text_flags(spark, values, expected):
    df = rows(spark, "i int, s string", *enumerate(values))
    assert column(grades.with_flag(df, "s", "y").orderBy("i"), "y") == expected


def test_unparsable_time_falls_back_to_the_date(spark):
    df = rows(spark, "d timestamp_ntz, t string", (DAY, "07:30"), (DAY, "25:99"), (DAY, None))
    got = column(df.select(clock.combine_date_time("d", "t").alias("y")), "y")
    assert got == [datetime(2024, 3, 4, 7, 30), DAY, DAY]


def test_delay_days_are_floored_elapsed_time(spark):
    df = rows(spark, "a timestamp_ntz, b timestamp_ntz", (datetime(2024, 1, 1, 23), datetime(2024, 1, 2, 1)),
              (datetime(2024, 1, 2), datetime(2024, 1, 1, 23)), (DAY, None))
    assert column(df.select(clock.delay_days("a", "b").alias("y")), "y") == [0, -1, None]


def test_unknown_delay_is_not_compliant(spark):
    df = rows(spark, "h double", (24.0,), (24.1,), (None,))
    assert column(df.select(clock.within(F.col("h"), 24).alias("y")), "y") == [True, False, False]


def test_rules_read_raw_severity_and_count_null_flags_as_true(spark):
    schema = ("severity string, reportable boolean, incident_type string, medical_attention_required boolean, "
              "treatment_required boolean, medical_outcome string, actions_documented boolean")
    df = rows(spark, schema,
              ("High", False, "x", False, False, None, False), ("Critical", False, "x", False, False, None, False),
              ("low", False, " Assault ", False, False, None, False), ("low", None, "x", False, False, "RECOVERED", False),
              ("low", False, "x", False, None, None, False))
    got = rules.with_investigation_rules(df).collect()
    assert [r["investigation_required"] for r in got] == [True, False, True, True, True]
    assert [r["action_complete"] for r in got] == [False, False, True, True, False]
    lenient = rules.with_investigation_rules(df, null_is_true=False).collect()
    assert [r["investigation_required"] for r in lenient] == [True, False, True, False, False]


def test_date_filter_ends_at_midnight_unless_asked(spark):
    df = rows(spark, "incident_date timestamp_ntz", (datetime(2024, 3, 4),), (datetime(2024, 3, 4, 9),))
    assert rules.IncidentFilter(end="2024-03-04").apply(df).count() == 1
    assert rules.IncidentFilter(end="2024-03-04", inclusive_day=True).apply(df).count() == 2


def test_date_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    rows(spark, "incident_date timestamp_ntz, v int", (DAY, 1)).write.parquet(path)
    plan = rules.IncidentFilter(start="2024-01-01").apply(spark.read.parquet(path))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(incident_date), GreaterThanOrEqual(incident_date" in plan


def test_date_filter_skips_month_folders(spark, tmp_path):
    days = [(i, datetime(2024, 1 + i, 5)) for i in range(6)]
    source.write_prepared(rows(spark, "incident_id int, incident_date timestamp_ntz", *days), str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    kept = rules.IncidentFilter(start="2024-02-01", end="2024-03-31").apply(stored)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(incident_month" in plan
    assert column(kept.orderBy("incident_id"), "incident_id") == [1, 2]


def test_alert_rules_in_order_and_pharmacy_hits(spark):
    schema = "severity string, incident_type string, notification_delay_days double, reportable_bin int"
    df = rows(spark, schema, ("4", "Fall", None, 0), ("low", "Pharmacy", 9.0, 1), ("low", "Fall", 2.0, 1),
              ("3", "Fall", 1.0, 1), ("Medium", "Fall", None, 1))
    got = column(df.select(wording.alert_reason().alias("y")), "y")
    assert got == ["high_severity", "self_harm_risk", "late_notification", "reportable_moderate", None]


def test_extended_mitigations_escalate_reportable_moderate(spark):
    df = rows(spark, "severity string, incident_type string, notification_delay_days double, reportable_bin int", ("3", "x", None, 1))
    assert "Escalate" in df.select(wording.mitigations("extended").alias("y")).first()["y"][0]
    assert df.select(wording.mitigations().alias("y")).first()["y"][0].startswith("Log incident")


def _spelled(parsed):
    """Every text a pattern of the rules stands for, boundaries and ``.*`` left out."""
    from itertools import product

    found = [""]
    for kind, value in parsed:
        name = str(kind)
        if name == "LITERAL":
            each = [chr(value)]
        elif name == "IN":
            each = [chr(code) for _, code in value]
        elif name == "BRANCH":
            each = [text for branch in value[1] for text in _spelled(branch)]
        elif name == "SUBPATTERN":
            each = _spelled(value[3])
        elif name == "MAX_REPEAT":
            each = ["", *(_spelled(value[2]) if str(value[2][0][0]) != "ANY" else [])]
        else:
            assert name == "AT"
            each = [""]
        found = [a + b for a, b in product(found, each)]
    return found


def test_stems_are_in_whatever_a_factor_pattern_matches():
    from re import _parser

    for (pattern, _), stems in zip(fixed.FACTOR_PATTERNS, fixed.FACTOR_STEMS, strict=True):
        texts = _spelled(_parser.parse(pattern))
        assert all(any(stem in text for stem in stems) for text in texts), pattern
        assert all(any(stem in text for text in texts) for stem in stems), pattern


def test_factor_rules_run_on_one_copy_of_the_text(spark):
    plan = spark.range(1).select(wording.factor_label(F.concat(F.lit("Wet "), F.col("id").cast("string"))).alias("y"))
    shown = plan._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("lower(") == 1


def test_factor_words_do_not_depend_on_where_the_text_is_cut(spark):
    made = []
    for size in range(240, 260):
        made += [("of " * 80 + "x" * (size - 240) + " first second", size), ("qqq" + "," * (size - 10) + "abcdefgh rest", size), ("of,the," * 200 + "last", size)]
    table = rows(spark, "s string, size int", *made)
    for row in table.select("s", "size", wording.factor_label("s").alias("y")).collect():
        words = [w for w in re.findall(fixed.FACTOR_TOKEN_PATTERN, row["s"]) if w not in fixed.FACTOR_STOP_WORDS]
        assert row["y"] == " ".join(w.capitalize() for w in words[:2])


def test_factor_labels(spark):
    df = rows(spark, "s string", ("  Wet Floor not clearly marked ",), ("Depressed mood",), ("of the staff",), ("",), (None,),
              ("purple x-ray elephants",), ("staff training and fatigue",))
    assert column(df.select(wording.factor_label("s").alias("y")), "y") == [
        "Wet floor", "Mental health", "Other", "Unknown", "Unknown", "Purple X-Ray", "Fatigue"]


def test_top_values_break_ties_by_name(spark):
    df = rows(spark, "v string", ("b",), ("a",), ("c",), ("c",))
    assert column(joins.top_values(df, "v", 2), "v") == ["c", "a"]


def test_severity_report_has_zero_rows(spark):
    got = {r["severity"]: r["count"] for r in reports.severity_distribution(rows(spark, "severity string", ("Low",))).collect()}
    assert got == {"Low": 1, "Medium": 0, "High": 0, "Critical": 0}


def test_trend_from_zero_is_flat(spark):
    change, direction = reports.trend(F.col("a"), F.col("b"))
    df = rows(spark, "a int, b int", (5, 0), (3, 4), (6, 4)).select(change.alias("c"), direction.alias("d"))
    assert [tuple(r) for r in df.collect()] == [(0.0, "flat"), (25.0, "down"), (50.0, "up")]


def test_median_of_even_count_is_interpolated(spark):
    made = [("c", DAY, datetime(2024, 3, 4 + n)) for n in (0, 1, 2, 7)]
    df = rows(spark, "carer_id string, incident_date timestamp_ntz, notification_date timestamp_ntz", *made)
    row = carers.delay_by_carer(df).first()
    assert (row["median_delay"], row["max_delay"], row["avg_delay"]) == (1.5, 7, 2.5)


def test_incident_ids_and_person_ids(spark):
    df = rows(spark, "incident_date timestamp_ntz, severity string, reported_by string",
              (datetime(2024, 2, 1), "low", None), (datetime(2024, 1, 1), "low", "A  b"))
    got = prepare.derive(df).orderBy("incident_id").collect()
    assert [(r["incident_id"], r["carer_id"]) for r in got] == [(1, "A_b_1"), (2, "unknown_2")]
    assert got[0]["location"] == "Unknown" and got[0]["reportable_bin"] == 0


def test_missing_required_columns_are_reported(spark):
    with pytest.raises(ValueError, match="severity"):
        source.conform(rows(spark, "incident_date timestamp_ntz", (DAY,)))


def test_csv_with_bad_dates(spark, tmp_path):
    (tmp_path / "i.csv").write_text("incident_id,severity,incident_date,reported_by\n1,low,2024-03-04,x\n2,low,not a date,x\n")
    got = source.read_csv(spark, str(tmp_path / "i.csv")).collect()
    assert [(r["incident_id"], r["incident_weekday"]) for r in got] == [(1, "Monday")]


def test_numeric_frame_replaces_non_finite(spark):
    df = rows(spark, "x double", (float("inf"),), (float("nan"),), (None,), (2.0,))
    assert column(df.select(common.finite_or_zero("x").alias("y")), "y") == [0.0, 0.0, 0.0, 2.0]


def test_jitter_is_steady_and_bounded(spark):
    df = rows(spark, "a string", ("1 A St, Bondi, NSW 2026",), ("1 A St, Bondi, NSW 2026",), (None,))
    lat, lon = places.jitter("a", F.lit(-33.9))
    got = [tuple(r) for r in df.select(lat, lon).collect()]
    assert got[0] == got[1] and got[2] == (0.0, 0.0)
    assert 0 < abs(got[0][0]) <= 250 / 111000


def test_given_coordinates_are_not_moved(spark):
    schema = "address string, location string, latitude double, longitude double"
    df = rows(spark, schema, ("1 A St, Bondi, NSW 2026", "x", -30.0, 150.0), (None, "near Penrith", -30.0, None), (None, "x", None, None))
    got = [(r["latitude"], r["longitude"]) for r in geography.with_coordinates(df).collect()]
    assert sorted(got, key=str) == sorted([(-30.0, 150.0), (-33.751, 150.692), (None, None)], key=str)


def test_several_geocoder_answers_do_not_multiply_rows(spark):
    df = rows(spark, "incident_id int, location string", (1, "a"), (2, "a"), (3, None))
    answers = rows(spark, "location string, lat double, lon double", ("a", 2.0, 2.0), ("a", 1.0, 5.0))
    got = {r["incident_id"]: r["lat"] for r in geography.with_geocoded(df, answers).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: None}


def test_sizes_count_what_values_hold(spark):
    from incidentry.operators import joins

    wide = spark.range(2000).select("id", F.array_repeat(F.lit(1.5), 1536).alias("vector"))
    rows, size = joins.counted_size(wide)
    assert rows == 2000 and size > 2000 * 1536 * 8
    nested = spark.sql("select map('a', array(named_struct('t', repeat('x', 1000)))) m, cast(null as array<int>) n, binary('abc') b")
    assert 1000 < joins.counted_size(nested)[1] < 1300
    many = spark.range(4000).select("id", F.array_repeat(F.lit(1.5), 1536).alias("vector"))
    assert joins.is_small(wide) and not joins.is_small(many)


def test_similar_in_passes_equals_one_pass(spark):
    from incidentry.operators import similarity

    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(120)
    vectors = similarity.unit_vectors(table, "vec_id", ["embedding"])
    whole = sorted(map(tuple, similarity.similar(vectors, vectors, 3).collect()))
    assert sorted(map(tuple, similarity.similar(vectors, vectors, 3, pass_bytes=20_000).collect())) == whole and len(whole) == 360


def test_similar_with_copies_ties_and_repeated_ids(spark):
    from incidentry.operators import similarity

    dice = np.random.default_rng(5)
    places = dice.choice([0.0, 1.0, 2.0], size=(400, 3))
    places /= np.maximum(np.linalg.norm(places, axis=1, keepdims=True), 1e-9)
    ids = [i // 2 if i < 60 else i for i in range(400)]
    df = spark.createDataFrame([(i, row.tolist()) for i, row in zip(ids, places)], "id bigint, vector array<double>")
    asked = [(i, row) for i, row in zip(ids, places) if i % 20 == 0 and i >= 60] + [(4, places[8])]
    queries = spark.createDataFrame([(i, row.tolist()) for i, row in asked], df.schema)
    got = {}
    for r in similarity.similar(df, queries, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["similarity"]))
    assert len(got) == len(asked)
    for query, place in asked:
        scores = [(-(round(float(place @ row), 6) + 0.0), i) for i, row in zip(ids, places) if i != query]
        assert got[query] == [(i, -score) for score, i in sorted(scores)[:4]]
    assert similarity.similar(df, queries.where("id < 0"), 4).count() == 0


def test_similar_holds_few_similarities_at_a_time():
    """All of a block's at once would be 1600 MB."""
    import tracemalloc

    import pyarrow as pa
    from incidentry.operators import similarity

    dice = np.random.default_rng(6)
    vectors, queries = dice.normal(size=(10_000, 4)), dice.normal(size=(20_000, 4))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    queries /= np.linalg.norm(queries, axis=1, keepdims=True)
    block = pa.record_batch({"id": pa.array(range(10_000)), "vector": pa.array(vectors.tolist())})
    tracemalloc.start()
    found = pa.Table.from_batches(similarity._k_best(np.arange(100_000, 120_000), queries, [block], 3))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == 60_000 and most < 200 << 20


@pytest.mark.parametrize("spread", [0.02, 5.0])
def test_all_rows_search_is_exact_and_prunes(spark, spread):
    """Vectors around 12 centres, with copies, ties and a zero vector; leaves of 40 rows."""
    from incidentry.operators import similarity

    dice = np.random.default_rng(6)
    centres = dice.normal(size=(12, 8))
    made = [centres[i % 12] + spread * dice.normal(size=8) for i in range(600)]
    made = [v / np.linalg.norm(v) for v in made] + [made[0] / np.linalg.norm(made[0])] * 5 + [np.zeros(8)] * 2
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(made)], "id bigint, vector array<double>")
    got = {}
    for r in similarity.similar_to_all(df, 3, leaf_rows=40).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["similarity"]))
    scores = np.round(np.array(made) @ np.array(made).T, 6) + 0.0
    for i in range(len(made)):
        best = sorted((j for j in range(len(made)) if j != i), key=lambda j: (-scores[i, j], j))[:3]
        assert [(n, j) for n, j, _ in sorted(got[i])] == [(n + 1, j) for n, j in enumerate(best)]


@pytest.mark.parametrize("part_bytes", [48 << 20, 4096])
def test_vectors_without_clusters_meet_in_few_parts(spark, monkeypatch, part_bytes):
    """Every vector would visit nearly every leaf; the answers are exact, and a vector is copied once for each part."""
    from incidentry.operators import similarity, vector_tree

    dice = np.random.default_rng(9)
    made = dice.normal(size=(700, 16))
    made = np.concatenate([made / np.linalg.norm(made, axis=1)[:, None], np.zeros((2, 16))])
    made[600:605] = made[3]
    made[650] = made[4] + 1e-9
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(made)], "id bigint, vector array<double>")
    calls = []
    whole, compared = vector_tree._met_in_parts, vector_tree.compared
    monkeypatch.setattr(vector_tree, "_met_in_parts", lambda bounded, k, parts: calls.append(parts) or whole(bounded, k, parts))
    monkeypatch.setattr(vector_tree, "compared", lambda *a: compared(*a, part_bytes=part_bytes))
    got = {}
    for r in similarity.similar_to_all(df, 3, leaf_rows=10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["similarity"]))
    scores = np.round(made @ made.T, 6) + 0.0
    for i in range(len(made)):
        best = sorted((j for j in range(len(made)) if j != i), key=lambda j: (-scores[i, j], j))[:3]
        assert sorted(got[i]) == [(n + 1, j, scores[i, j]) for n, j in enumerate(best)]
    assert len(calls) == 1 and calls[0] == (8 if part_bytes > 4096 else 22)


@pytest.mark.parametrize("pending", [1, 1 << 13])
def test_near_pairs_of_a_part(monkeypatch, pending):
    """Bounds of -1, ties, a bound that is reached to the digit, a zero vector and one that is no number."""
    import pyarrow as pa
    from incidentry.operators import vector_tree

    dice = np.random.default_rng(4)
    made = np.concatenate([np.repeat(dice.normal(size=(60, 8)), 5, axis=0), np.zeros((1, 8))])
    made /= np.maximum(np.linalg.norm(made, axis=1), 1e-9)[:, None]
    scores = np.round(made @ made.T, 6) + 0.0
    bound = np.where(np.arange(len(made)) % 2, -1.0, -np.sort(-scores, axis=1)[:, 2])
    for name, value in (("PENDING", pending), ("BLOCK_ROWS", 64), ("PIECE_ROWS", 7)):
        monkeypatch.setattr(vector_tree, name, value)
    ids, leaf = np.arange(len(made)), np.arange(len(made)) % 9
    vectors = [*made.tolist(), [float("nan")] * 8]
    rows = pa.table({"group_id": [*ids, 900], "vector": vectors, "bound": [*bound, -1.0], "own": [*leaf, 0]})
    left, right, similar = vector_tree._near(rows, rows, 2, 6)
    got = {}
    for a, b, s in zip(left.tolist(), right.tolist(), similar.tolist()):
        got.setdefault(a, []).append((-s, b))
    for i in range(len(made)):
        assert sorted(got[i])[:3] == sorted((-scores[i, j], j) for j in ids.tolist())[:3]


def _pairs(spark, n):
    """Products that the search makes over n vectors in tight clusters of about 12, and the answers' number."""
    from incidentry.operators import similarity, vector_tree

    dice = np.random.default_rng(n)
    centres = dice.normal(size=(n // 12, 16))
    made = np.array([centres[i % len(centres)] for i in range(n)]) + 0.01 * dice.normal(size=(n, 16))
    made /= np.linalg.norm(made, axis=1)[:, None]
    groups = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(made)], "group_id bigint, vector array<double>")
    tree = vector_tree.build(groups, 3, 24)
    sizes = {r["node"]: r["n"] for r in tree.leaves.groupBy("node").agg(F.count("*").alias("n")).collect()}
    assert sum(sizes.values()) == n
    own = tree.leaves.groupBy("node").applyInPandas(lambda part: similarity._block_search(3)(part, part), vector_tree.PAIRS)
    met = vector_tree.visits(vector_tree.bounds(tree, own, 3), tree.levels).groupBy("node").agg(F.count("*").alias("n")).collect()
    return sum(size * size for size in sizes.values()) + sum(sizes[r["node"]] * r["n"] for r in met)


def test_compared_pairs_grow_far_below_the_square(spark):
    few, many = _pairs(spark, 2000), _pairs(spark, 6000)
    assert few < 2000**2 / 64 and many / 6000**2 < 0.75 * few / 2000**2


def test_vectors_that_differ_by_rounding_only(spark):
    from incidentry.operators import similarity

    made = [[1.0, 1e-13 * i] for i in range(60)]
    df = spark.createDataFrame(list(enumerate(made)), "id bigint, vector array<double>")
    got = {(r["query_id"], r["rank"]): r["id"] for r in similarity.similar_to_all(df, 2, leaf_rows=8).collect()}
    assert got[(0, 1)] == 1 and got[(30, 1)] == 0 and got[(30, 2)] == 1 and len(got) == 120
