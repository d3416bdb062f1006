import re

import corpus_pipeline
from incidentry.llm import quality
from incidentry.llm.common import store
from llm_cases import awkward
from test_llm_decontaminate import tiled, words
from test_llm_simhash import components_of, fingerprint

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, held = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    steps = [f for _, f in corpus_pipeline.STAGES]

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    good = store(steps[0](spark, docs, FOLDER), "test")
    kept = {r["doc_id"] for r in good.collect()}
    clean = [i for i in labels if labels[i] == 1]
    assert good.columns == columns and sum(i in kept for i in clean) >= 0.97 * len(clean)
    model = quality.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet").where(~quality.held_out(corpus_pipeline.F.col("doc_id"))))
    scores = dict(zip(held, model.scores([(t or "").encode() for t in held.values()])))
    assert kept == {i for i in held if scores[i] >= 0.3}

    single = store(steps[1](spark, good, FOLDER), "test")
    prints = {i: fingerprint(held[i]) for i in kept}
    roots = components_of(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 2)
    first = {}
    for i in sorted(kept):
        first.setdefault(roots[prints[i]], i)
    assert single.columns == columns and sorted(r["doc_id"] for r in single.collect()) == sorted(first.values())

    pure = store(steps[2](spark, single, FOLDER), "test")
    items = [words(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    seeds = {tuple(w[k : k + 4]) for w in items for k in range(len(w) - 3)}

    def leaked(text):
        own = words(text)
        if not any(tuple(own[k : k + 4]) in seeds for k in range(len(own) - 3)):
            return False
        return any(tiled(item, own, 4) >= 0.5 * len(item) for item in items if set(item) & set(own))

    expected = sorted(i for i in first.values() if not leaked(held[i]))
    assert pure.columns == columns and sorted(r["doc_id"] for r in pure.collect()) == expected

    mixed = store(steps[3](spark, pure, FOLDER), "test")
    ids = [r["doc_id"] for r in mixed.collect()]
    assert mixed.columns == columns and set(ids) == set(expected) and max(ids.count(i) for i in set(ids)) <= 2

    sharded = steps[4](spark, mixed, FOLDER).collect()
    assert sorted(r["doc_id"] for r in sharded) == sorted(ids)
    for number in {r["shard"] for r in sharded}:
        slots = sorted(r["slot"] for r in sharded if r["shard"] == number)
        assert slots == list(range(len(slots)))


def test_run_and_registration(spark):
    import __spark_entry__

    queries = __spark_entry__.queries()
    assert "pipeline" in queries and {int(re.match(r"op(\d+)_", q)[1]) for q in queries if re.match(r"op\d+_", q)} == set(range(1, 14))
    rows = queries["pipeline"](spark, FOLDER)
    assert {"shard", "slot", "doc_id", "text"} <= set(rows.columns) and rows.count() > 0


def folder_of(spark, path, docs, labels, items):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_awkward_rows_pass_all_stages(spark, tmp_path):
    """Null ids, texts and sources, repeated rows, a very long text and clashing names: nothing is rejected without a reason."""
    docs = awkward(spark)
    labels = [(i, None if i == 2 else int(i not in (3, 4, 5)), 0) for i in range(1, 13)] + [(None, 1, 0), (1, 1, 0)]
    folder = folder_of(spark, tmp_path / "awkward", docs, labels, [(1, None), (2, ""), (3, "too short"), (None, "four words not there")])
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = store(stage(spark, docs, folder), "test")
        assert docs.columns == awkward(spark).columns
        kept[name] = docs.collect()
    prints = [fingerprint(r["text"]) for r in kept["near_duplicates"]]
    assert len(prints) == len(set(prints)) and all((a ^ b).bit_count() > 2 for a in prints for b in prints if a != b)
    assert sorted(map(str, kept["decontamination"])) == sorted(map(str, kept["near_duplicates"]))
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert len(rows) == len(kept["mixing"]) and {type(r["shard"]) for r in rows} == {int}
    assert corpus_pipeline.run(spark, folder).count() == len(rows)


def test_tables_without_rows(spark, tmp_path):
    none = awkward(spark).where("false")
    folder = folder_of(spark, tmp_path / "none", none, [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0
    folder = folder_of(spark, tmp_path / "bare", awkward(spark), [], [])
    assert corpus_pipeline.run(spark, folder).count() > 0
