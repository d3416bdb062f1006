import re

import pytest
import xxhash
from incidentry.llm import components, simhash
from llm_cases import awkward, empty, frame, invented


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(nodes, linked):
    at = {n: n for n in nodes}

    def top(n):
        while at[n] != n:
            n = at[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((top(a), top(b)))
                at[y] = x
    return {n: top(n) for n in nodes}


def check(docs, **more):
    rows = [(r["doc_id"], fingerprint(r["text"])) for r in docs.select("doc_id", "text").collect()]
    roots = components_of({f for _, f in rows}, lambda a, b: (a ^ b).bit_count() <= more.get("distance", 2))
    least = {}
    for i, f in rows:
        if i is not None:
            least[roots[f]] = min(i, least.get(roots[f], i))
    found = simhash.near_duplicates(docs, **more)
    expected = sorted((str(i), f"{f:016x}", str(least.get(roots[f]))) for i, f in rows)
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in found.collect()) == expected
    kept = simhash.keep_one(docs, **{k: v for k, v in more.items() if k != "keep_text"})
    assert kept.count() == len({roots[f] for _, f in rows})
    assert kept.columns == docs.columns


def test_awkward_rows(spark):
    check(awkward(spark))


def test_empty_table(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("distance", [0, 1, 2])
def test_near_copies(spark, distance):
    check(frame(spark, invented(150, seed=1)), distance=distance)


@pytest.mark.parametrize("crowded", [0, 2, 1000])
def test_links_of_crowded_keys(spark, crowded):
    """Prints around a few centres: all distances from 0 to 5 occur, and keys are shared by many."""
    import random

    pick = random.Random(5)
    values = set()
    for centre in (0, (1 << 64) - 1, pick.getrandbits(64)):
        for _ in range(60):
            value = centre
            for bit in pick.sample(range(64), pick.randrange(0, 4)):
                value ^= 1 << bit
            values.add(value)
    signed = {v - (1 << 64) if v >> 63 else v for v in values}
    prints = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    found = {r["node"]: r["root"] for r in components.connected(simhash.links(prints, 2, crowded)).collect()}
    expected = components_of(signed, lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2)
    assert {v: found.get(v, v) for v in signed} == expected


def test_components_of_paths_hubs_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(5, 5), (None, 3), (200, 201), (201, 200)]
    found = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert all(found[i] == 0 for i in range(1, 41)) and all(found[i] == 100 for i in range(101, 160)) and found[201] == 200
    assert components.connected(spark.createDataFrame([], "u string, v string")).count() == 0
