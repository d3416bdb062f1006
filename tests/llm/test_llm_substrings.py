import random

import pytest
from incidentry.llm import substrings
from llm_cases import awkward, empty, frame


def brute(rows, size):
    """(id, text) -> the words kept of each row."""
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, words in split:
        for k in range(len(words) - size + 1 if i is not None else 0):
            window = tuple(words[k : k + size])
            first[window] = min(i, first.get(window, i))
    out = []
    for (i, text), (_, words) in zip(rows, split):
        keep = [True] * len(words)
        for k in range(len(words) - size + 1 if i is not None else 0):
            if first[tuple(words[k : k + size])] < i:
                keep[k : k + size] = [False] * size
        out.append((str(i), str(text), b" ".join(w for w, k in zip(words, keep) if k).decode(), len(words), len(words) - sum(keep)))
    return sorted(out)


def check(docs, size):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = substrings.without_repeats(docs, size).collect()
    assert sorted((str(r["doc_id"]), str(r["text"]), r["kept_text"], r["n_words"], r["n_removed"]) for r in found) == brute(rows, size)
    for r in found:
        words = (r["text"] or "").encode().split()
        gone = {i for low, high in r["spans"] for i in range(low, high)}
        assert b" ".join(w for i, w in enumerate(words) if i not in gone).decode() == r["kept_text"]


def passages(n, seed):
    """Texts that share passages, one of them in a third of all."""
    pick = random.Random(seed)
    shared = [" ".join(f"p{s}w{i}" for i in range(pick.randrange(8, 60))) for s in range(6)]
    texts = []
    for i in range(n):
        parts = [" ".join(f"v{pick.randrange(500)}" for _ in range(pick.randrange(30))) for _ in range(3)]
        middle = shared[0] if i % 3 == 0 else pick.choice(shared)
        texts.append(f" {parts[0]}\t{middle}\n{parts[1]}  {pick.choice(shared)} {parts[2]} ")
    return texts + ["same same " * 40, "same " * 33, "é " * 20, "é " * 25]


@pytest.mark.parametrize("size", [1, 3, 8, 50])
def test_against_brute_force(spark, size):
    check(frame(spark, passages(80, size)), size)


def test_crowded_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SAMPLE_SHARE", 1)
    monkeypatch.setattr(substrings, "CROWDED_WINDOWS", 20)
    docs = frame(spark, passages(80, 9))
    first, pairs = substrings._crowded(docs, "text", 8)
    assert len(first) and len(pairs)
    check(docs, 8)


def test_small_chunks(spark):
    """Buckets are cut only between minimisers, whatever the batches."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        check(frame(spark, passages(30, 4)), 5)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_colliding_hashes_are_told_apart(monkeypatch):
    import numpy as np

    monkeypatch.setattr(substrings, "_hash", lambda sums, start, end: np.zeros(len(start), np.uint64))
    text, place, best = substrings._earliest([b"a b c", b"x b c", b"b c d"], np.array([3, 2, 1]), 2)
    assert list(zip(text.tolist(), place.tolist(), best.tolist())) == [(0, 0, 3), (0, 1, 1), (1, 0, 2), (1, 1, 1), (2, 0, 1), (2, 1, 1)]


def test_awkward_rows(spark):
    docs = awkward(spark)
    check(docs, 10)
    assert set(docs.columns) <= set(substrings.without_repeats(docs, 10).columns)


def test_empty_table(spark):
    assert substrings.without_repeats(empty(spark), 5).count() == 0
