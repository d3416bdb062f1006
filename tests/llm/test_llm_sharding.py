from collections import defaultdict

import pytest
from incidentry.llm import sharding
from llm_cases import awkward, empty, frame, invented


def weight(text):
    return len((text or "").encode()) + 8


def shards_of(rows):
    found = defaultdict(list)
    for r in rows:
        found[r["shard"]].append(r)
    return found


@pytest.mark.parametrize("pieces", ["1", "64"])
def test_near_equal_bytes_and_gapless_slots(spark, pieces):
    docs = frame(spark, invented(600, words=120))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", pieces)
    try:
        rows = sharding.shard(docs, 8).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(r["doc_id"] for r in rows) == list(range(600))
    found = shards_of(rows)
    total, largest = sum(weight(r["text"]) for r in rows), max(weight(r["text"]) for r in rows)
    for number in range(8):
        held = found[number]
        assert abs(sum(weight(r["text"]) for r in held) - total / 8) <= largest + 0.04 * total / 8
        assert sorted(r["slot"] for r in held) == list(range(len(held)))


def test_equal_texts_share_a_shard_unless_they_are_too_many(spark):
    rows = sharding.shard(frame(spark, invented(400, words=60) + ["a hot text"] * 2), 4).collect()
    at = defaultdict(set)
    for r in rows:
        at[r["text"]].add(r["shard"])
    assert all(len(places) == 1 for places in at.values())
    hot = sharding.shard(frame(spark, ["a hot text, copied again and again"] * 300 + invented(100, words=10)), 4).collect()
    sizes = [sum(weight(r["text"]) for r in held) for held in shards_of(hot).values()]
    assert max(sizes) < 1.1 * min(sizes)


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = sharding.shard(docs, 3)
    assert sorted(rows.columns) == sorted(docs.columns)
    assert rows.count() == docs.count()
    assert {r["shard"] for r in rows.collect()} <= {0, 1, 2}


def test_empty_table(spark):
    assert sharding.shard(empty(spark), 3).count() == 0


def test_repeatable(spark):
    docs = frame(spark, invented(100))
    one = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(docs, 5).collect()}
    two = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(docs.repartition(3), 5).collect()}
    assert one == two
