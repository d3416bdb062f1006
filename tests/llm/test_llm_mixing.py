import math
from collections import Counter, defaultdict

import pytest
from incidentry.llm import mixing
from llm_cases import awkward, empty


def table(spark, per_source):
    rows, i = [], 0
    for source, n in per_source.items():
        for _ in range(n):
            rows.append((i, "w " * (1 + i % 9) + str(i), source))
            i += 1
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)


def tokens(rows):
    found = Counter()
    for r in rows:
        found[r["source"]] += len((r["text"] or "").split())
    return found


SIZES = {"hot": 900, "b": 300, "c": 100, "d": 60, None: 40}


@pytest.mark.parametrize("limit", [1.0, 2.0, 3.5, 1000.0])
def test_repetition_limit(spark, limit):
    docs = table(spark, SIZES)
    have = tokens(docs.collect())
    rows = mixing.mix(docs, repetitions=limit).collect()
    got = tokens(rows)
    ratio = math.log(max(have.values()) / min(have.values()))
    a = max(0.0, 1 - math.log(limit) / ratio)
    for source, n in have.items():
        wanted = n * (max(have.values()) / n) ** (1 - a)
        assert wanted - 12 <= got[source] <= wanted + 1
    copies = Counter(r["doc_id"] for r in rows)
    assert min(copies.values()) >= 1 and max(copies.values()) <= math.ceil(limit)
    for number in copies:
        assert sorted(r["copy"] for r in rows if r["doc_id"] == number) == list(range(copies[number]))


def test_entropy_and_budget(spark):
    docs = table(spark, SIZES)
    have = tokens(docs.collect())
    whole = sum(have.values())
    rows = mixing.mix(docs, entropy=1.3, budget=whole / 2).collect()
    got = tokens(rows)
    weight = {r["source"]: r["weight"] for r in rows}
    assert abs(-sum(w * math.log(w) for w in weight.values()) - 1.3) < 1e-6
    assert abs(sum(weight.values()) - 1) < 1e-9
    for source in have:
        assert weight[source] * whole / 2 - 12 <= got[source] <= weight[source] * whole / 2 + 1


def test_prefixes_keep_the_weights(spark):
    rows = sorted(mixing.mix(table(spark, {"a": 3000, "b": 1000}), repetitions=1.5).collect(), key=lambda r: r["position"])
    assert all(0 <= r["position"] < 1 for r in rows)
    whole = tokens(rows)
    half = tokens([r for r in rows if r["position"] < 0.5])
    for source in whole:
        assert abs(half[source] / whole[source] - 0.5) < 0.05


def test_passes_have_orders_of_their_own(spark):
    rows = mixing.mix(table(spark, {"a": 2000, "b": 400}), repetitions=4).collect()
    places = defaultdict(dict)
    for r in rows:
        places[r["copy"]][r["doc_id"]] = r["position"]
    both = sorted(set(places[0]) & set(places[1]), key=places[0].get)
    turned = sum(places[1][x] > places[1][y] for x, y in zip(both, both[1:]))
    assert turned > len(both) // 10


def test_exponents(spark):
    shares = spark.createDataFrame([(0.7,), (0.2,), (0.1,)], "share double")
    assert mixing.exponent(shares) == 1.0
    assert mixing.exponent(shares, entropy=99.0) == 0.0
    assert mixing.exponent(shares, entropy=0.0) == 1.0
    assert mixing.exponent(shares, repetitions=100.0) == 0.0
    assert abs(mixing.exponent(shares, repetitions=7.0 ** 0.5) - 0.5) < 1e-9
    assert mixing.exponent(shares.where("false"), entropy=1.0) == 1.0


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = mixing.mix(docs, repetitions=2)
    assert set(docs.columns) <= set(rows.columns)
    found = Counter(str((r["doc_id"], r["text"])) for r in rows.collect())
    for key, n in Counter(str((r["doc_id"], r["text"])) for r in docs.collect()).items():
        assert n <= found[key] <= 2 * n


def test_empty_table(spark):
    assert mixing.mix(empty(spark), repetitions=2).count() == 0
    assert mixing.mix(empty(spark), entropy=1.0).count() == 0
