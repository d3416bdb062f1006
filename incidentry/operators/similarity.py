"""Most similar incidents by cosine of standardised features."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Normalizer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incidentry.operators import vector_tree
from incidentry.operators.joins import counted_size, lookup_join
from incidentry.session import settle

DIGITS = 6  # similarities are compared and returned at this precision, so ties do not depend on summation order
LEFT_ROWS = 1024
PASS_BYTES = 32 << 20
CELLS = 1 << 20
UNKNOWN, NONE = -2.0, -3.0  # below any cosine: of a vector that is no number, and of no row


def unit_vectors(df: DataFrame, row_id: str, columns: Sequence[str]) -> DataFrame:
    """(id, vector): number columns, or one array column, scaled by mean and deviation and then to length one.

    The choice between sample and population deviation cancels in the second step. A zero row stays zero.
    """
    if len(columns) == 1 and isinstance(df.schema[columns[0]].dataType, T.ArrayType):
        packed = F.col(columns[0]).cast("array<double>")
    else:
        packed = F.array(*[F.col(f"`{name}`").cast("double") for name in columns])
    rows = df.select(F.col(row_id).alias("id"), array_to_vector(packed).alias("_raw"))
    scaler = StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True).fit(rows)
    unit = Normalizer(inputCol="_scaled", outputCol="_unit", p=2.0).transform(scaler.transform(rows))
    return unit.select("id", vector_to_array("_unit").alias("vector"))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties by id."""
    return np.lexsort((ids, -scores))[:k]


def similar(corpus: DataFrame, queries: DataFrame, k: int = 5, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The k corpus rows most similar to each query row, itself excluded by id; both are (id, vector) of length one or zero.

    Of equal corpus vectors only the k + 1 smallest ids can be answers, so no others are searched. The query batch is counted and cut into
    passes of at most about ``pass_bytes``. In each pass its part goes to every task as one matrix, and each task keeps k rows per query; only
    those are shuffled. Tasks compute CELLS similarities at a time. A pass is stored before the next one starts.
    """
    copies = Window.partitionBy("vector").orderBy("id")
    rows = corpus.withColumn("_copy", F.dense_rank().over(copies)).where(F.col("_copy") <= k + 1).select("id", "vector")
    rows = settle(rows.repartition(2 * corpus.sparkSession.sparkContext.defaultParallelism))  # few bytes may be much work
    queries = settle(queries)
    _, size = counted_size(queries)
    passes = max(1, -(-size // pass_bytes))
    if passes == 1:
        return _nearest(_searched(rows, queries, k), k)
    part = F.pmod(F.xxhash64("id"), F.lit(passes))
    found = [settle(_nearest(_searched(rows, queries.where(part == number), k), k)) for number in range(passes)]
    return reduce(DataFrame.unionByName, found)


def _nearest(kept: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _matrix(column: pa.ListArray) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(len(column), -1)


def _keep(best_scores: np.ndarray, best_ids: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
    """Take ``scores`` (a row per query, a column for each of the ascending ``ids``) into the best ones of the queries, in place."""
    k, width = best_scores.shape[1], len(ids)
    touched = np.flatnonzero((scores >= best_scores[:, -1:]).any(axis=1))
    if not len(touched):
        return
    scores = scores[touched]
    if width > k:
        # one number for each pair orders by score, then by id
        order = np.rint(np.maximum(scores, NONE) * 10**DIGITS) * width - np.arange(width)
        top = np.argpartition(order, width - k, axis=1)[:, width - k :]
        scores, ids = np.take_along_axis(scores, top, 1), ids[top]
    else:
        ids = np.broadcast_to(ids, scores.shape)
    scores = np.concatenate([best_scores[touched], scores], axis=1)
    ids = np.concatenate([best_ids[touched], ids], axis=1)
    first = np.lexsort((ids, -scores), axis=1)[:, :k]
    best_scores[touched], best_ids[touched] = np.take_along_axis(scores, first, 1), np.take_along_axis(ids, first, 1)


def _k_best(query_ids: np.ndarray, query_matrix: np.ndarray, blocks: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    best_scores, best_ids = np.full((len(query_ids), k), NONE), np.zeros((len(query_ids), k), np.int64)
    for block in blocks if len(query_ids) else ():
        if not block.num_rows:
            continue
        ids = np.asarray(block.column("id"))
        by_id = np.argsort(ids, kind="stable")
        ids, vectors = ids[by_id], _matrix(block.column("vector"))[by_id].T
        step = max(1, CELLS // len(ids))
        for low in range(0, len(query_ids), step):
            part = slice(low, low + step)
            scores = np.round(query_matrix[part] @ vectors, DIGITS) + 0.0
            np.copyto(scores, UNKNOWN, where=np.isnan(scores))
            scores[query_ids[part, None] == ids] = NONE
            _keep(best_scores[part], best_ids[part], scores, ids)
    for low in range(0, len(query_ids), LEFT_ROWS):
        scores, found = best_scores[low : low + LEFT_ROWS], best_ids[low : low + LEFT_ROWS]
        row, place = np.nonzero(scores > NONE)
        told = scores[row, place]
        columns = [query_ids[low + row], found[row, place], np.where(told == UNKNOWN, np.nan, told)]
        yield pa.RecordBatch.from_arrays([pa.array(column) for column in columns], ["query_id", "id", "similarity"])


def _searched(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best rows per query and task."""
    batch = queries.toArrow().combine_chunks()
    query_ids = np.asarray(batch.column("id"))
    query_matrix = _matrix(batch.column("vector").combine_chunks()) if len(query_ids) else np.empty((0, 0))
    return corpus.mapInArrow(lambda blocks: _k_best(query_ids, query_matrix, blocks, k), "query_id bigint, id bigint, similarity double")


def _block_search(k: int):
    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(left) and len(right):
            ids, matrix = right["group_id"].to_numpy(), vector_tree.matrix(right["vector"]).T
            for start in range(0, len(left), LEFT_ROWS):
                part = left.iloc[start : start + LEFT_ROWS]
                scores = np.round(vector_tree.matrix(part["vector"]) @ matrix, DIGITS) + 0.0
                for group, row in zip(part["group_id"], scores):
                    best = _best(ids, row, k + 1)
                    found.append((np.full(len(best), group), ids[best], row[best]))
        columns = [np.concatenate(values) for values in zip(*found)] if found else [[], [], []]
        return pd.DataFrame(dict(zip(("left_id", "right_id", "similarity"), columns)))

    return search


def similar_to_all(corpus: DataFrame, k: int = 5, leaf_rows: int = vector_tree.LEAF_ROWS) -> DataFrame:
    """The k most similar rows for every row of (id, vector) of length one or zero, exact.

    Equal vectors are compared once: each distinct vector keeps its k + 1 smallest ids, and no other id of it can be in an
    answer. Comparisons keep k + 1 vectors for each vector, so pairs are neither shuffled nor written.
    """
    copies = Window.partitionBy("vector").orderBy("id")
    groups = settle(
        corpus.withColumn("_copy", F.row_number().over(copies))
        .where(F.col("_copy") <= k + 1)
        .groupBy("vector")
        .agg(F.min("id").alias("group_id"), F.array_sort(F.collect_list("id")).alias("ids"))
    )
    compared = vector_tree.compared(groups, k, _block_search(k), leaf_rows)
    best = Window.partitionBy("left_id").orderBy(F.desc("similarity"), "right_id")
    near = compared.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= k + 1)
    candidates = near.join(groups.select(F.col("group_id").alias("right_id"), "ids"), "right_id").select(
        "left_id", "similarity", F.explode("ids").alias("id")
    )
    nearest = Window.partitionBy("left_id").orderBy(F.desc("similarity"), "id")
    answers = (
        candidates.withColumn("_rank", F.row_number().over(nearest))
        .where(F.col("_rank") <= k + 1)
        .groupBy("left_id")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("order"), "id"))).alias("_near"))
    )
    by_vector = settle(answers.join(groups.select(F.col("group_id").alias("left_id"), "vector", "ids"), "left_id").drop("left_id"))
    # up to k ids are all that have the vector; only rows of more copies are looked up by it
    complete = by_vector.where(F.size("ids") <= k).select(F.explode("ids").alias("query_id"), "_near")
    crowded = by_vector.where(F.size("ids") > k).drop("ids")
    copied = lookup_join(corpus.withColumnRenamed("id", "query_id"), crowded, "vector", "query_id", "inner").select("query_id", "_near")
    rows = complete.unionByName(copied)
    others = F.slice(F.filter("_near", lambda c: c["id"] != F.col("query_id")), 1, k)
    return rows.select("query_id", F.posexplode(others).alias("_place", "_hit")).select(
        "query_id", F.col("_hit.id").alias("id"), (0.0 - F.col("_hit.order")).alias("similarity"), (F.col("_place") + 1).alias("rank")
    )
