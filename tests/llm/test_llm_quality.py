import numpy as np
from incidentry.llm import quality
from incidentry.llm.queries import op3_quality
from llm_cases import awkward, empty

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = [r for r in op3_quality(spark, FOLDER).collect() if r["doc_id"] in labels and r["held_out"]]
    good = [r for r in rows if labels[r["doc_id"]] == 1]
    bad = [r for r in rows if labels[r["doc_id"]] == 0]
    assert np.mean([r["predicted"] for r in good]) >= 0.97
    assert np.mean([1 - r["predicted"] for r in bad]) >= 0.6
    assert np.mean([r["score"] for r in good]) > np.mean([r["score"] for r in bad]) + 0.5


def model(n=40):
    texts = [f"plain words number {i} stand in this sentence" for i in range(n)] + [f"@@@ ### {i} $$$ %%%" for i in range(n)]
    return texts, quality.fit_terms([quality.terms(t.encode()) for t in texts], [1] * n + [0] * n)


def test_votes_against_plain_loops():
    texts, fitted = model()
    assert fitted.vectors.shape[0] == 80
    asked = [t.encode() for t in ["some plain words here", "### @@@", "", texts[3]]]
    vectors = fitted.project(map(quality.terms, asked))
    for vector, found in zip(vectors, fitted.scores(asked)):
        cosine = [float(v @ vector) for v in fitted.vectors]
        best = sorted(range(80), key=lambda i: -cosine[i])
        cut = cosine[best[quality.NEIGHBOURS - 1]]
        sure = [i for i in best if cosine[i] > cut + 1e-5]
        votes = [max(cosine[i], 0) ** quality.SHARPNESS for i in sure]
        if len(sure) >= quality.NEIGHBOURS - 1:
            assert abs(found - np.dot(votes, [fitted.labels[i] for i in sure]) / sum(votes)) < 0.1
    assert fitted.scores([b"plain words stand"])[0] > 0.7 and fitted.scores([b"%%% $$$ ###"])[0] < 0.3


def test_blocks_do_not_matter(monkeypatch):
    texts, fitted = model()
    asked = [t.encode() for t in texts]
    whole = fitted.scores(asked)
    monkeypatch.setattr(quality, "SCORE_BLOCK", 7)
    assert np.allclose(whole, fitted.scores(asked), atol=1e-5)


def test_the_fit_is_bounded_and_needs_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(30)] + [(3, "text 3")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, None if i == 4 else i % 2) for i in range(30)] + [(None, 1)], "doc_id bigint, quality int")
    assert len(quality.fit(docs, labels, most=10).labels) <= 10
    none = quality.fit(docs, labels.where("false"))
    assert set(none.scores([b"a", b""])) == {0.5}


def test_awkward_rows(spark):
    _, fitted = model()
    docs = awkward(spark)
    rows = quality.with_scores(docs, fitted)
    assert sorted(rows.columns) == sorted(docs.columns)
    scores = [r["score"] for r in rows.collect()]
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
    assert quality.with_scores(empty(spark), fitted).count() == 0
