"""A tree of pivots over vectors of length one at most, and the exact nearest vectors of every vector by it.

Each level splits the nodes with more than ``leaf_rows`` vectors: FAN vectors of the node, picked by a hash, become the centres of its children, and
every vector goes to the nearest. The number of nodes follows the number of vectors. A child is known by rings: how near and how far its vectors
are from each centre of the node. Vectors meet the centres on their way down and their own leaf first, which is where a descent by the nearest
centres ends. The similarity reached there is a bound, and the vector goes down the tree again, level by level, to all children whose
rings may hold something as similar. Rows of a node that very many vectors visit are spread over salts.

Where vectors do not fall into clusters most leaves would be visited by most vectors, and the visits alone would grow with the square of the
rows. They are counted for some vectors first. If a vector visits more leaves than there are parts of PART_BYTES, it goes to every part once
instead, with its bound, and meets there the pieces of leaves that are within its reach. Parts are as few as memory allows, so what is shuffled is
a small multiple of the input; only the products grow with the square.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from incidentry.operators.joins import lookup_join
from incidentry.session import settle

FAN, LEAF_ROWS, NODE_ROWS = 16, 4096, 8192
PROBES = 512  # vectors whose visits are counted
PART_BYTES = 48 << 20
BLOCK_ROWS, PIECE_ROWS, PENDING = 2048, 256, 1 << 13
SLACK = 1e-6  # similarities are rounded
PAIRS = "left_id bigint, right_id bigint, similarity double"
Search = Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=float).reshape(len(vectors), -1)


def distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squares = (rows**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * rows @ centres.T
    return np.sqrt(np.maximum(squares, 0))


def _met(rows: DataFrame, others: DataFrame, meet: Search, schema: str) -> DataFrame:
    """``meet(rows of a node, others of the node)`` by the column ``node`` of both; nodes with over NODE_ROWS rows are met in parts."""
    counts = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > NODE_ROWS)
    crowded = settle(counts.select("node", F.ceil(F.col("n") / NODE_ROWS).cast("int").alias("salts")))
    spread = lookup_join(rows, crowded, "node", "group_id")
    salted = spread.withColumn("salt", F.pmod(F.xxhash64("group_id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    salts = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
    copies = lookup_join(others, crowded, "node", "node").withColumn("salt", F.explode(salts)).drop("salts")
    copies = copies.withColumnsRenamed({"node": "at_node", "salt": "at_salt"})
    return salted.groupBy("node", "salt").cogroup(copies.groupBy("at_node", "at_salt")).applyInPandas(meet, schema)


def _assigning(k: int, digits: int) -> Search:
    def assign(rows: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        """The child whose centre is nearest, the distances of all centres, and the k + 1 most similar centres."""
        if not len(rows):
            return pd.DataFrame({name: [] for name in ("group_id", "vector", "node", "away", "near", "similar")})
        centres = centres.sort_values("child")
        ids, places, vectors = centres["child"].to_numpy(), matrix(centres["centre"]), matrix(rows["vector"])
        away, alike = distances(vectors, places), np.round(vectors @ places.T, digits) + 0.0
        best = np.argsort(-alike, axis=1, kind="stable")[:, : k + 1]
        return pd.DataFrame(
            {
                "group_id": rows["group_id"],
                "vector": rows["vector"],
                "node": ids[away.argmin(axis=1)],
                "away": list(away),
                "near": list(ids[best]),
                "similar": list(np.take_along_axis(alike, best, 1)),
            }
        )

    return assign


PLACED = "group_id bigint, vector array<double>, node bigint, away array<double>, near array<bigint>, similar array<double>"


@dataclass
class Tree:
    """Leaves (group_id, vector, node), level by level the children (node, child, centre, low, high, leaf) below the root 0, and PAIRS met on the way."""

    leaves: DataFrame
    levels: list[DataFrame]
    met: DataFrame


def build(groups: DataFrame, k: int, leaf_rows: int = LEAF_ROWS, fan: int = FAN, digits: int = 6) -> Tree:
    """A tree over ``groups`` (group_id, vector), which are different vectors."""
    rows = groups.select("group_id", "vector", F.lit(0).cast("bigint").alias("node"))
    done, levels, met = [], [], []
    picked = Window.partitionBy("node").orderBy(F.xxhash64("group_id"), "group_id")
    while True:
        first = rows.withColumn("rank", F.row_number().over(picked)).where(F.col("rank") <= fan)
        centres = settle(first.select("node", F.col("group_id").alias("child"), F.col("vector").alias("centre")))  # a child is named by its centre
        placed = settle(_met(rows, centres, _assigning(k, digits), PLACED))
        met.append(placed.select(F.col("group_id").alias("left_id"), F.inline(F.arrays_zip("near", "similar")).alias("right_id", "similarity")))
        rings = placed.select(F.col("node").alias("child"), F.posexplode("away").alias("pos", "away")).groupBy("child", "pos")
        rings = rings.agg(F.min("away").alias("low"), F.max("away").alias("high"), F.count(F.lit(1)).alias("n"))
        rings = rings.groupBy("child").agg(F.array_sort(F.collect_list(F.struct("pos", "low", "high"))).alias("rings"), F.max("n").alias("n"))
        whole = F.sum("n").over(Window.partitionBy("node"))  # a node that does not come apart, as its vectors differ by rounding only, is a leaf
        children = centres.join(rings, "child").withColumn("leaf", (F.col("n") <= leaf_rows) | (F.col("n") == whole))
        levels.append(settle(children.select("node", "child", "centre", F.col("rings.low").alias("low"), F.col("rings.high").alias("high"), "leaf")))
        leaves = levels[-1].select(F.col("child").alias("node"), "leaf")
        marked = settle(lookup_join(placed.select("group_id", "vector", "node"), leaves, "node", "group_id"))
        done.append(marked.where("leaf").drop("leaf"))
        rows = marked.where("not leaf").drop("leaf")
        if rows.isEmpty():
            break
    return Tree(reduce(DataFrame.unionByName, done), levels, reduce(DataFrame.unionByName, met))


def _may_hold(rows: pd.DataFrame, children: pd.DataFrame) -> pd.DataFrame:
    """Each vector once for every child that may hold a vector at least as similar as its bound.

    With |x| <= 1 a vector x of that similarity lies within the root of |q|^2 + 1 - 2 bound of q, so its distance from any centre is within
    that reach of q's own.
    """
    shape = ["group_id", "vector", "bound", "own", "node", "leaf"]
    if not len(rows) or not len(children):
        return pd.DataFrame({name: [] for name in shape})
    children = children.sort_values("child")
    q = matrix(rows["vector"])
    reach = np.sqrt(np.maximum((q**2).sum(axis=1) + 1 - 2 * (rows["bound"].to_numpy() - SLACK), 0)) + SLACK
    away, low, high = distances(q, matrix(children["centre"])), matrix(children["low"]), matrix(children["high"])
    may = np.stack([((away + reach[:, None] >= a) & (away - reach[:, None] <= b)).all(axis=1) for a, b in zip(low, high)], axis=1)
    row, child = np.nonzero(may)
    found = rows.iloc[row][["group_id", "vector", "bound", "own"]].reset_index(drop=True)
    found["node"], found["leaf"] = children["child"].to_numpy()[child], children["leaf"].to_numpy()[child]
    return found[(found["node"] != found["own"]) | ~found["leaf"]]


def visits(bounded: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(group_id, vector, node): the leaves but its own that a vector (group_id, vector, bound, own) has to be compared with."""
    rows = bounded.withColumn("node", F.lit(0).cast("bigint"))
    found = []
    for children in levels:
        shape = "group_id bigint, vector array<double>, bound double, own bigint, node bigint, leaf boolean"
        rows = settle(_met(rows, children, _may_hold, shape))
        found.append(rows.where("leaf").select("group_id", "vector", "node"))
        rows = rows.where("not leaf").drop("leaf")
    return reduce(DataFrame.unionByName, found)


def compared(groups: DataFrame, k: int, search: Search, leaf_rows: int = LEAF_ROWS, part_bytes: int = PART_BYTES) -> DataFrame:
    """(left_id, right_id, similarity): for every vector lists that hold its k + 1 most similar ones, itself included."""
    tree = build(groups, k, leaf_rows)
    own = settle(tree.leaves.groupBy("node").applyInPandas(lambda part: search(part, part), PAIRS))
    bounded = settle(bounds(tree, own, k))
    size = bounded.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(8 * F.size("vector")), F.lit(0)).alias("bytes")).first()
    some = settle(bounded.orderBy(F.xxhash64("group_id")).limit(PROBES))
    parts = max(-(-size["bytes"] // part_bytes), math.isqrt(9 * groups.sparkSession.sparkContext.defaultParallelism))
    if visits(some, tree.levels).count() > parts * min(PROBES, size["rows"]):
        return _met_in_parts(bounded, k, parts)
    return own.unionByName(_met(visits(bounded, tree.levels), tree.leaves, search, PAIRS))


def _met_in_parts(bounded: DataFrame, k: int, parts: int, digits: int = 6) -> DataFrame:
    """PAIRS of every vector with the k + 1 most similar ones of each part that reach its bound; a pair is met in one task."""
    part, every = F.pmod(F.xxhash64("group_id"), F.lit(parts)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = bounded.select("group_id", "vector", "bound", "own", part.alias("row"), every.alias("column"))
    right = bounded.select("group_id", "vector", "own", every.alias("row"), part.alias("column"))

    def meet(some: pa.Table, others: pa.Table) -> pa.Table:
        columns = _near(some, others, k, digits) if some.num_rows and others.num_rows else [[], [], []]
        kinds = {"left_id": pa.int64(), "right_id": pa.int64(), "similarity": pa.float64()}
        return pa.table({name: pa.array(column, kind) for (name, kind), column in zip(kinds.items(), columns)})

    return left.groupBy("row", "column").cogroup(right.groupBy("row", "column")).applyInArrow(meet, PAIRS)


def _by_leaf(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows by leaf, and their ids and vectors in this order."""
    order = np.argsort(np.asarray(table.column("own")), kind="stable")
    vectors = np.asarray(table.column("vector").combine_chunks().flatten(), dtype=float).reshape(len(order), -1)
    return order, np.asarray(table.column("group_id"))[order], vectors[order]


def _near(some: pa.Table, others: pa.Table, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left_id, right_id, similarity): the k + 1 best of ``others`` for each of ``some``, none that is known not to be among the best of all.

    Products of single precision find the pairs that may reach the bound, with room for their error; similarities are computed in double.
    """
    order, left_ids, q = _by_leaf(some)
    _, right_ids, x = _by_leaf(others)
    bound = np.asarray(some.column("bound"), dtype=float)[order]
    # an error of single precision is at most this for vectors of length one, and similarities are rounded
    slack = (q.shape[1] + 8) * 2.0**-23 + SLACK
    q4, x4 = q.astype(np.float32), x.astype(np.float32)
    pieces = [(low, min(len(x), low + PIECE_ROWS)) for low in range(0, len(x), PIECE_ROWS)]
    centres = np.array([x[low:high].mean(axis=0) for low, high in pieces])
    radii = np.array([distances(x[low:high], centre[None]).max() for (low, high), centre in zip(pieces, centres)])
    squares = (q**2).sum(axis=1) + 1
    found = []
    for first in range(0, len(q), BLOCK_ROWS):
        block, last = slice(first, first + BLOCK_ROWS), min(len(q), first + BLOCK_ROWS)
        odd = ~np.isfinite(q[block]).all(axis=1)
        reached, pending, waiting = bound[block].copy(), [], 0
        away = distances(q[block], centres) - radii
        for (low, high), gap in zip(pieces, away.T):
            # see _may_hold; what is no number is never out of reach
            near = ~(gap > np.sqrt(np.maximum(squares[block] - 2 * (reached - SLACK), 0)) + SLACK)
            rows = np.flatnonzero(near)
            if not len(rows):
                continue
            whole = 2 * len(rows) > last - first
            if whole:
                rows = np.arange(last - first)
            side = q4[block] if whole else q4[first + rows]
            row, column = np.divmod(np.flatnonzero(~(side @ x4[low:high].T < (reached[rows] - slack).astype(np.float32)[:, None])), high - low)
            if not len(row):
                continue
            row = rows[row]
            if 16 * len(row) > len(rows) * (high - low):
                similar = (q[block] @ x[low:high].T)[row, column]
            else:
                similar = np.einsum("ij,ij->i", q[first + row], x[low + column])
            similar = np.round(similar, digits) + 0.0
            use = (similar >= reached[row]) | odd[row]
            pending.append((row[use], right_ids[low + column[use]], similar[use]))
            waiting += int(use.sum())
            if waiting > PENDING:  # the sooner a row's bound is raised, the fewer pairs pass
                pending, waiting = [_best_of(pending, k, reached)], 0
        if pending:
            row, ids, similar = _best_of(pending, k, reached)
            found.append((left_ids[first + row], ids, similar))
    return tuple(np.concatenate(columns) for columns in zip(*found)) if found else ([], [], [])


def _best_of(pending: list[tuple], k: int, reached: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k + 1 best (row, id, similarity) of each row, ties by id; what they reach is raised in place."""
    row, ids, similar = (np.concatenate(columns) for columns in zip(*pending))
    order = np.lexsort((ids, -similar, row))
    row, ids, similar = row[order], ids[order], similar[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    full = rank == k
    reached[row[full]] = np.fmax(reached[row[full]], similar[full])
    return row[rank <= k], ids[rank <= k], similar[rank <= k]


def bounds(tree: Tree, own: DataFrame, k: int) -> DataFrame:
    """(group_id, vector, bound, own): a similarity that k + 1 vectors are known to reach, -1 where fewer are known, and the leaf."""
    known = own.unionByName(tree.met).groupBy("left_id", "right_id").agg(F.max("similarity").alias("similarity"))
    best = Window.partitionBy("left_id").orderBy(F.desc("similarity"))
    reached = known.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k + 1).select(F.col("left_id").alias("group_id"), F.col("similarity").alias("bound"))
    rows = tree.leaves.join(reached, "group_id", "left")
    return rows.select("group_id", "vector", F.coalesce("bound", F.lit(-1.0)).alias("bound"), F.col("node").alias("own"))
