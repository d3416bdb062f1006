import numpy as np
import pytest
from pyspark.sql import functions as F

from incidentry.models import classifiers, scenarios, splits
from incidentry.models.guard import LeakageGuard
from incidentry.operators import clustering, evaluation, similarity
from incidentry.plans.prepare import derive, prepare
from incidentry.sources.orders_view import incidents

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return prepare(incidents(spark, FOLDER)).persist()


@pytest.fixture(scope="module")
def planted(rows):
    """A target the models can find: kitchens, and a third of the rest at night."""
    hit = (F.col("is_kitchen") == 1) | ((F.col("hour") < 6) & (F.col("incident_id") % 3 == 0))
    table = rows.withColumn("target", F.when(hit, 1).otherwise(0))
    return classifiers.compare_models(table, target="target", strategy="random")


def test_planted_signal_is_found_by_both(planted):
    assert set(planted) == {"RandomForest", "LogisticRegression"}
    for trained in planted.values():
        assert trained.accuracy > 0.8
        assert trained.cv_accuracy > 0.75 and 0 <= trained.cv_deviation < 0.2
        area = evaluation.curve_areas(trained.predictions).first()
        assert 0.7 < area["roc_auc"] <= 1


def test_predictions_are_whole_and_scores_are_chances(planted, rows):
    scored = planted["RandomForest"].predictions
    assert abs(scored.count() - rows.count() * 0.25) <= 2
    assert scored.where("probability < 0 or probability > 1").count() == 0
    assert evaluation.confusion_matrix(scored).agg(F.sum("count")).first()[0] == scored.count()


def test_ranking_names_the_planted_feature(planted, spark):
    names = [r["feature"] for r in classifiers.feature_ranking(planted["RandomForest"], spark).collect()]
    assert any("Kitchen" in name for name in names[:3])


def test_scenarios_are_scored_and_raise_alerts(planted, spark):
    filled = scenarios.filled_scenarios(scenarios.preset_scenarios(spark))
    got = {r["scenario"]: r for r in filled.collect()}
    kitchen = got["Early Morning Kitchen Risk"]
    assert (kitchen["hour"], kitchen["participant_history"], kitchen["carer_history"], kitchen["location_risk"]) == (6, 3, 5, 3)
    scores = scenarios.risk_scores(filled, planted["RandomForest"])
    by_name = {r["scenario"]: r["risk_score"] for r in scores.collect()}
    assert by_name["Early Morning Kitchen Risk"] > by_name["Weekend Transport Risk"]
    alerts = scenarios.scenario_alerts(scores, {"high": 0.0, "medium": 1.0}).collect()
    assert [r["scenario"] for r in alerts] == ["Early Morning Kitchen Risk"] and len(alerts[0]["recommendation"]) == 3


def test_guard_never_drops_everything(spark):
    df = spark.createDataFrame([(float(i % 2), float(i % 2) + (i % 7 == 0), i % 2) for i in range(50)], "severity_x double, status double, label int")
    model = LeakageGuard(["severity_x", "status"]).fit(df)
    assert model.kept == ["status"]
    assert model.transform(df).select("features").count() == 50


def test_guard_with_given_columns_checks_names_only(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0), (2.0, 1.0, 1)], "hour double, report_count double, label int")
    model = LeakageGuard(["hour", "report_count"], columns_out=["hour", "report_count", "gone"]).fit(df)
    assert model.kept == ["hour"]


def test_guard_is_fitted_once_per_fold_for_all_models(rows, monkeypatch):
    fits = []
    fit = LeakageGuard._fit
    monkeypatch.setattr(LeakageGuard, "_fit", lambda self, dataset: fits.append(1) or fit(self, dataset))
    models = classifiers.compare_models(rows)
    assert len(fits) == 4  # all training rows, and three folds
    assert all(0 <= trained.cv_accuracy <= 1 for trained in models.values())


def test_guard_sketches_only_columns_that_may_be_distinct(spark, monkeypatch):
    asked = []
    sketched = LeakageGuard._sketched
    monkeypatch.setattr(LeakageGuard, "_sketched", lambda self, dataset, names: asked.append(list(names)) or sketched(self, dataset, names))
    made = [(i, i % 7, i / 3, float("nan") if i == 3 else float(i % 5), None, 1.0, None if i % 4 else i % 3, i % 2) for i in range(400)]
    kinds = "number bigint, week int, third double, broken double, nothing double, same double, some int, label int"
    model = LeakageGuard(["number", "week", "third", "broken", "nothing", "same", "some"]).fit(spark.createDataFrame(made, kinds))
    categories = {row[0]: row[1] for row in model.rows if row[1]}
    assert categories == {
        "number": "unique_ratio_drops", "third": "unique_ratio_drops", "nothing": "all_null_drops", "same": "variance_drops",
    }
    assert asked == [["number", "third", "broken"]]


def test_groups_stay_on_one_side(rows):
    halves = splits.group_split(rows, "participant_id").groupBy("participant_id").agg(F.count_distinct("is_test").alias("sides"))
    assert halves.where("sides > 1").count() == 0


def test_folds_are_even_in_every_class(rows):
    sizes = splits.with_folds(classifiers.with_label(rows), 3).groupBy("label", "fold").count()
    spread = sizes.groupBy("label").agg((F.max("count") - F.min("count")).alias("d"))
    assert spread.where("d > 1").count() == 0


def test_clusters_cover_all_rows(rows):
    frame = clustering.cluster_features(rows)
    assert "severity_numeric" not in frame.columns
    placed = clustering.clusters(frame, k=3, components=3, scaled=True, starts=2).persist()
    assert placed.count() == rows.count()
    assert {r["cluster"] for r in placed.select("cluster").distinct().collect()} == {0, 1, 2}
    means = placed.agg(*[F.avg(f"pc{i}") for i in (1, 2, 3)]).first()
    assert np.allclose(means, 0, atol=1e-6)


def test_standard_vectors_have_population_deviation_one(spark):
    from pyspark.ml.feature import VectorAssembler

    df = VectorAssembler(inputCols=["x"], outputCol="vector").transform(spark.createDataFrame([(1.0,), (2.0,), (6.0,)], "x double"))
    got = [r["vector"][0] for r in clustering.standard_vectors(df).collect()]
    assert np.std(got) == pytest.approx(1) and np.mean(got) == pytest.approx(0)


def brute(matrix, ids, k):
    scaled = (matrix - matrix.mean(axis=0)) / np.where(matrix.std(axis=0) > 0, matrix.std(axis=0), 1)
    length = np.linalg.norm(scaled, axis=1, keepdims=True)
    unit = np.divide(scaled, length, out=np.zeros_like(scaled), where=length > 0)
    scores = np.round(unit @ unit.T, 6) + 0.0
    answer = {}
    for i, row in enumerate(scores):
        others = [(-s, j) for s, j in zip(row, ids) if j != ids[i]]
        answer[ids[i]] = [(j, -s + 0.0) for s, j in sorted(others)[:k]]
    return answer


@pytest.mark.parametrize("leaf_rows", [4, 4096])
def test_similar_to_all_matches_brute_force(spark, leaf_rows):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 3, size=(12, 4)).astype(float)
    matrix = np.vstack([base, np.repeat(base[:1], 20, axis=0), base[1:4]])  # one vector holds most rows
    ids = list(range(100, 100 + len(matrix)))
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in zip(ids, matrix)], "id bigint, a double, b double, c double, d double")
    vectors = similarity.unit_vectors(df, "id", ["a", "b", "c", "d"])
    expected = brute(matrix, ids, 3)
    got = {}
    for r in similarity.similar_to_all(vectors, 3, leaf_rows).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["similarity"]))
    assert got == expected
    one = similarity.similar(vectors, vectors.where("id = 105"), 3).orderBy("rank").collect()
    assert [(r["id"], r["similarity"]) for r in one] == expected[105]


def test_default_target_needs_no_histories(spark):
    table = classifiers.with_label(derive(incidents(spark, FOLDER)))
    assert table.where("label = 1 and severity_numeric < 3").count() == 0


def test_splits_of_stored_scaled_vectors_follow_their_bytes(spark, monkeypatch):
    """Few different values pack well, so a split of a packed file would hold far more rows."""
    import os

    from incidentry import session

    stored = []
    monkeypatch.setattr(clustering, "settle", lambda df, **how: stored.append(session.settle(df, **how)) or stored[-1])
    df = spark.range(20_000).selectExpr("id incident_id", *[f"cast(id % {n} as double) c{n}" for n in range(2, 10)])
    found = clustering.clusters(df, k=2, components=2, scaled=True, starts=1)
    assert found.count() == 20_000
    paths = [path.removeprefix("file:").removeprefix("//") for path in stored[-1].inputFiles()]
    assert sum(os.path.getsize(path) for path in paths) > 20_000 * 8 * 8
