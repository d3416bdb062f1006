"""Language-model scores against plain loops: counts, the recurrent model step by step, its gradient, and held-out texts."""

import math
import zlib
from collections import Counter

import llm_cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from incidentry.llm import lm, recurrent
from incidentry.llm.queries import QUERIES

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*(text or "").encode().translate(LOWER).split(), b""]


def softmax(x):
    e = np.exp(x - x.max())
    return e / e.sum()


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Plain:
    """Counts, and the model written out for one token at a time."""

    def __init__(self, rows):
        self.c = Counter(t for _, text, learn in rows if learn for t in tokens(text))
        self.n, self.v = sum(self.c.values()), len(self.c)
        words = sorted((w for w in self.c if 0 < len(w) <= 64), key=lambda w: (-self.c[w], w))
        self.ids = {w: i for i, w in enumerate([b"", *words[: recurrent.HEAD - 1]])}
        self.rare = {}
        for k in range(recurrent.KINDS):
            some = [n for w, n in self.c.items() if w not in self.ids and lm.kind(w) == k]
            self.rare[k] = sum(some), len(some)

    def base(self, text):
        return sum(math.log10((self.c[t] + 0.1) / (self.n + 0.1 * (self.v + 1))) for t in tokens(text))

    def shares(self, w, state):
        """Probability of every id after a state."""
        classes = softmax(state @ w["to_class"] + w["class_bias"])
        words = [classes[k] * softmax(state @ w["to_word"][k] + w["word_bias"][k]) for k in range(recurrent.CLASSES)]
        return np.concatenate([*words, classes[recurrent.CLASSES :]])

    def score(self, w, text):
        w = {name: x.astype(np.float64) for name, x in w.items()}
        state, last, total = np.zeros(recurrent.STATE), 0, 0.0
        for t in tokens(text):
            pre, loop = w["inputs"][:, last], [state @ part for part in w["loops"]]
            update, candidate = sigmoid(pre[0] + loop[0]), np.tanh(pre[1] + loop[1])
            state = (1 - update) * candidate + update * state
            last = self.ids.get(t, recurrent.HEAD + lm.kind(t))
            total += math.log10(self.shares(w, state)[last])
            if t not in self.ids:
                n, words = self.rare[lm.kind(t)]
                total += math.log10((self.c[t] + 0.1) / (n + 0.1 * (words + 1)))
        return total


def compare(monkeypatch, docs, learn, texts=None):
    """Scores every row and compares it with plain loops; the trained weights are taken from the operator."""
    kept = []
    real = lm.trained

    def watched(rows, weights):
        kept.append(real(rows, weights))
        return kept[-1]

    monkeypatch.setattr(lm, "trained", watched)
    got = lm.score_texts(docs, learn, most=30_000).collect()
    rows = [(r["doc_id"], r["text"], r["learns"]) for r in docs.withColumn("learns", F.coalesce(learn, F.lit(False))).collect()]
    plain = Plain(rows)
    expected = Counter()
    known = {}
    for key, text, _ in rows:
        if text not in known:
            t = tokens(text)
            known[text] = (len(t), sum(plain.c[x] > 0 for x in t), plain.n, plain.base(text), plain.score(kept[0], text) if len(t) < 150 else None)
        expected[(key, text)] += 1
    assert Counter((r["doc_id"], r["text"]) for r in got) == expected
    for r in got:
        n, n_known, total, base, score = known[r["text"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, n_known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0
        if score is not None:
            assert r["score"] == pytest.approx(score, rel=2e-4, abs=2e-3)
    return got, plain, kept[0]


def test_table_against_plain_version(spark, monkeypatch):
    docs = spark.read.parquet(f"{llm_cases.FOLDER}/documents.parquet").select("doc_id", "text").repartition(3)
    held = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 10 == 0
    got, plain, weights = compare(monkeypatch, docs, ~held)
    out = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0]
    assert out and sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    state = np.random.default_rng(0).normal(0, 1, recurrent.STATE)
    assert plain.shares(weights, state).sum() == pytest.approx(1, abs=1e-6)


def test_query_beats_the_base_on_held_out_texts(spark):
    rows = QUERIES["op13_lm_scores"](spark, "/root/testdata/sf0.01")
    assert set(rows.columns) == {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"}
    out = rows.where("held_out").select(F.sum("n_tokens"), F.sum("base_score"), F.sum("score")).first()
    assert (out[2] - out[1]) / out[0] > 0.1


def test_order_of_words_matters(spark):
    lines = ["the cat sat on the mat and the dog ran after the cat"] * 40
    docs = spark.createDataFrame([(i, " ".join(lines)) for i in range(60)] + [(100, " ".join(lines)), (101, " ".join(sorted(" ".join(lines).split())))], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in lm.score_texts(docs, F.col("doc_id") < 60).collect()}
    assert got[100]["base_score"] == pytest.approx(got[101]["base_score"])
    assert got[100]["score"] > got[100]["base_score"] and got[100]["score"] > got[101]["score"]


def test_awkward_and_empty_tables(spark, monkeypatch):
    docs = llm_cases.awkward(spark).drop("score")
    for name in ["chunk", "seq", "keys", "n", "kinds", "learn", "c0", "n_tokens"]:
        docs = docs.selectExpr("*", f"'old' AS {name}")
    compare(monkeypatch, docs.withColumn("use", F.col("doc_id") != 8), F.col("use"))
    rows = lm.score_texts(docs, F.col("doc_id") != 8, keep_text=False)
    assert rows.columns == [c for c in docs.columns if c not in ("n_tokens", "text")] + list(lm.RESULTS)
    nothing = lm.score_texts(docs.drop("n_tokens"), F.lit(False)).collect()
    assert {(r["n_known"], r["train_tokens"], r["base_score"]) for r in nothing} == {(0, 0, 0.0)}
    assert lm.score_texts(llm_cases.empty(spark), F.lit(True)).count() == 0


def test_gradients_are_differences_of_the_loss():
    pick = np.random.default_rng(0)
    ids = recurrent.HEAD + recurrent.KINDS
    weights = {name: w + pick.normal(0, 0.3, w.shape) for name, w in recurrent.started(pick.integers(1, 100, ids)).items()}
    given, targets = pick.integers(0, ids, (5, 4)), pick.integers(0, ids, (5, 4))
    given[2, 1] = 0
    counted = np.ones((5, 4), np.float32)
    counted[4, 3] = 0
    start = pick.normal(0, 0.3, (4, recurrent.STATE))
    found, _, loss = recurrent.gradients({k: w.astype(np.float32) for k, w in weights.items()}, given, targets, counted, start.astype(np.float32))

    def lost():
        state, total = start, 0.0
        for t in range(5):
            state = recurrent._step(weights, given[t], np.where((given[t] == 0)[:, None], 0, state))[0]
            total -= (recurrent.log_shares(weights, state, targets[t]) * counted[t]).sum()
        return total

    assert loss == pytest.approx(lost(), rel=1e-4)
    for name, w in weights.items():
        for _ in range(8):
            at = tuple(pick.integers(0, n) for n in w.shape)
            if name == "inputs":
                at = at[0], given.ravel()[pick.integers(20)], at[2]
            old = w[at]
            w[at] = old + 1e-5
            above = lost()
            w[at] = old - 1e-5
            slope = (above - lost()) / 2e-5 / counted.sum()
            w[at] = old
            assert found[name][at] == pytest.approx(slope, rel=1e-2, abs=1e-4)


def test_scores_do_not_depend_on_the_company():
    pick = np.random.default_rng(5)
    weights = {name: w + pick.normal(0, 0.3, w.shape).astype(np.float32) for name, w in recurrent.started(np.ones(recurrent.HEAD + recurrent.KINDS)).items()}
    texts = [np.append(pick.integers(1, recurrent.HEAD + recurrent.KINDS, n), 0).astype(np.uint16) for n in [0, 1, 5, 400, 33, 400, 2]]
    together = recurrent.score_all(weights, texts)
    assert together == pytest.approx([recurrent.score_all(weights, [t])[0] for t in texts], rel=1e-5)
    assert len(recurrent.score_all(weights, [])) == 0
