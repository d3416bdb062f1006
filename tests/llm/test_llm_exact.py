import hashlib

from incidentry.llm import exact
from llm_cases import awkward, empty, frame, invented


def normal(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def check(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = exact.exact_groups(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        same = [i for i, t in rows if normal(t) == normal(r["text"])]
        assert r["group_size"] == len(same)
        assert r["keep_id"] == max((i for i in same if i is not None), default=None)
        assert r["normalised"] == normal(r["text"])
    groups = {normal(t) for _, t in rows}
    kept = [r for r in found if r["kept"]]
    assert len(kept) == len(groups) == len({r["normalised"] for r in kept})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_awkward_rows(spark):
    docs = awkward(spark)
    check(docs)
    assert set(docs.columns) <= set(exact.exact_groups(docs).columns)
    assert exact.keep_one(docs).columns == docs.columns


def test_empty_table(spark):
    assert exact.exact_groups(empty(spark)).count() == 0


def test_large_groups_are_split_by_further_bytes(spark, monkeypatch):
    monkeypatch.setattr(exact, "LARGE_ROWS", 20)
    lead = "x" * 300
    texts = ["Same text for all of these"] * 50 + [f"{lead}{i % 40}" for i in range(60)] + [lead] * 30 + invented(40)
    check(frame(spark, texts))


def test_nulls_in_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(exact, "LARGE_ROWS", 5)
    rows = [(None if i % 3 else i, "Again") for i in range(40)] + [(7, "again"), (39, "AGAIN")]
    check(spark.createDataFrame(rows, "doc_id bigint, text string"))


def test_no_digest_decides(spark):
    pair = ["a" * 5000 + "b", "a" * 5000 + "c"]
    found = exact.exact_groups(frame(spark, pair)).collect()
    assert {r["group_size"] for r in found} == {1}
    assert len({hashlib.sha256(r["normalised"].encode()).hexdigest() for r in found}) == 2
