import random
import re

import pytest
from incidentry.llm import decontaminate
from llm_cases import awkward, empty, frame

FOLDER = "/root/testdata/sf0.001"


def tiled(a, b, least):
    """Greedy string tiling by its definition: covered words of ``a``."""
    used_a, used_b, covered = [False] * len(a), [False] * len(b), 0
    while True:
        best, found = least - 1, []
        for p in range(len(a)):
            for t in range(len(b)):
                n = 0
                while p + n < len(a) and t + n < len(b) and a[p + n] == b[t + n] and not used_a[p + n] and not used_b[t + n]:
                    n += 1
                if n > best:
                    best, found = n, []
                if n == best and n >= least:
                    found.append((p, t))
        if not found:
            return covered
        for p, t in found:
            if not any(used_a[p : p + best]) and not any(used_b[t : t + best]):
                used_a[p : p + best] = used_b[t : t + best] = [True] * best
                covered += best


@pytest.mark.parametrize("letters", [2, 4, 12])
def test_tiles_against_the_definition(letters):
    pick = random.Random(letters)
    for _ in range(60):
        a = [str(pick.randrange(letters)) for _ in range(pick.randrange(1, 40))]
        b = [str(pick.randrange(letters)) for _ in range(pick.randrange(1, 60))]
        found = decontaminate.tiles(a, b, 3)
        assert sum(n for n, _, _ in found) == tiled(a, b, 3)
        for n, p, t in found:
            assert n >= 3 and a[p : p + n] == b[t : t + n]
        assert [n for n, _, _ in found] == sorted((n for n, _, _ in found), reverse=True)


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def check(spark, docs, items):
    """Every document against every item."""
    benchmark = spark.createDataFrame(items, "item_id bigint, text string, item string")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    expected = []
    for i, text in rows:
        cover = [(tiled(words(t), words(text), 4) / len(words(t)), k) for k, t, _ in items if len(words(t)) >= 4]
        hits = sorted((-c, k) for c, k in cover if c >= 0.5 - 1e-9)
        expected.append((str(i), bool(hits), round(-hits[0][0], 9) if hits else 0.0, hits[0][1] if hits else None, len({k for _, k in hits})))
    found = decontaminate.judged(docs, benchmark).collect()
    assert sorted(map(str, ((str(r["doc_id"]), r["contaminated"], round(r["coverage"], 9), r["item_id"], r["items"]) for r in found))) == sorted(map(str, expected))
    assert decontaminate.clean(docs, benchmark).count() == sum(not e[1] for e in expected)


def test_reordered_and_partial_passages(spark):
    pick = random.Random(8)
    items = [(k, " ".join(f"b{k}x{i}" for i in range(24)), "-") for k in range(8)] + [(8, "too short", "-"), (9, None, "-"), (10, "", "-"), (3, "b3x0 b3x1 b3x2 b3x3 b3x4 other", "-")]
    texts = []
    for k in range(40):
        part = words(items[k % 8][1])
        cut = [part[i : i + 6] for i in range(0, 24, 6)]
        pick.shuffle(cut)
        chosen = cut[: 1 + k % 4]
        filler = [f"f{pick.randrange(99)}" for _ in range(30)]
        texts.append(" ".join(filler[:10] + [w.upper() + "," for c in chosen for w in [*c, "and"]] + filler[10:]))
    check(spark, frame(spark, texts), items)


def test_awkward_rows(spark):
    docs = awkward(spark)
    check(spark, docs, [(1, "QUICK brown fox, jumps over the lazy dog", "i"), (1, "word word word word word", "i"), (None, "lazy dog while seven wizards", "i")][:2])
    assert set(docs.columns) <= set(decontaminate.judged(docs, spark.createDataFrame([], "item_id bigint, text string")).columns)


def test_empty_tables(spark):
    benchmark = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    assert decontaminate.judged(empty(spark), benchmark).count() == 0
    docs = frame(spark, ["a b c d e f", None, ""])
    assert decontaminate.clean(docs, benchmark.where("false")).count() == 3
    assert decontaminate.clean(docs, benchmark).count() == 2


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    usual = {(r["doc_id"], r["coverage"]) for r in decontaminate.judged(docs, benchmark).collect()}
    real = decontaminate.seed_filter
    monkeypatch.setattr(decontaminate, "seed_filter", lambda *a: real(*a) | 255)
    assert {(r["doc_id"], r["coverage"]) for r in decontaminate.judged(docs, benchmark).collect()} == usual


def test_a_stock_phrase_joins_nothing(spark, monkeypatch):
    """300 documents and 300 items that share one run of four words, and one item that is held."""
    joined = []
    real = decontaminate.candidates
    monkeypatch.setattr(decontaminate, "candidates", lambda *a: joined.append(real(*a)) or joined[-1])
    phrase = "all rights reserved worldwide"
    docs = [(i, " ".join(f"d{i}w{j}" for j in range(30)) + f" {phrase} " + " ".join(f"e{i}w{j}" for j in range(9))) for i in range(300)]
    items = [(i, " ".join(f"i{i}w{j}" for j in range(16)) + " " + phrase) for i in range(300)]
    docs.append((1000, "before " + items[7][1] + " after"))
    docs, items = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.contaminated(docs, items).collect()
    assert [(r["key"], r["item"], r["coverage"]) for r in found] == [(1000, 7, 1.0)]
    assert joined[0].count() == 1


def test_a_document_that_holds_many_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "LIST_ITEMS", 3)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(12))) for i in range(20)]
    docs = [(1, " ".join(text for _, text in items)), (2, items[3][1]), (None, items[4][1])]
    found = decontaminate.judged(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {r["doc_id"]: (r["items"], r["item_id"]) for r in found.collect()} == {1: (20, 0), 2: (1, 3), None: (1, 4)}
