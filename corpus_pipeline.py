"""A training corpus from ``documents``: quality, near-duplicates, benchmark passages, source weights, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentry.llm import decontaminate, mixing, quality, sharding, simhash
from incidentry.llm.common import store, table

SHARDS, KEEP_SCORE = 24, 0.3
SHINGLE_WORDS, MOST_BITS = 3, 2
REPETITIONS = 2.0


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of at least KEEP_SCORE, from labels outside the held-out fifth."""
    labels = table(spark, sf_dir, "labels").where(~quality.held_out(F.col("doc_id")))
    model = quality.fit(docs, labels)
    return docs.where(quality.score(model, F.col("text"), spark) >= KEEP_SCORE)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs, size=SHINGLE_WORDS, distance=MOST_BITS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; documents of small sources up to REPETITIONS times."""
    own = {name: f"c{i}" if name not in ("doc_id", "text", "source") else name for i, name in enumerate(docs.columns)}
    named = docs.select(*[F.col(f"`{name}`").alias(other) for name, other in own.items()])  # results of the mixing replace equal names
    mixture = mixing.mix(named, repetitions=REPETITIONS, ordered=False)
    return mixture.select(*[F.col(other).alias(name) for name, other in own.items()])


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SHARDS shards of near equal bytes, with ``shard`` and ``slot``."""
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", distinct),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
