"""Shards of near equal bytes by histogram sort.

The order is (hash of the text, hash of the id). Exact bytes and rows below candidate boundaries are counted over all partitions, the
probes between two known boundaries are refined until each splitter meets its tolerance, and the rows are exchanged once. Shards are cut
into pieces by further splitters, so that a task holds a piece and not a shard; the histogram also gives the rows before each piece,
from which slots follow without another pass. Equal texts are neighbours in this order and share a shard unless that would
move a boundary by more than ``group_slack`` of a shard.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from incidentry.llm.common import fresh, store, text_bytes, without

LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
PIECE_BYTES, MOST_PIECES, MOST_PROBES = 64 << 20, 16_384, 16_384

Key = tuple[int, int]


@dataclass
class Splitter:
    """A boundary in search: the keys known to lie at or before and after its target, with the bytes and rows below them."""

    target: float
    tolerance: float
    group_tolerance: float
    low: Key = (LOWEST, LOWEST)
    low_bytes: int = 0
    low_rows: int = 0
    high: Key = (HIGHEST, HIGHEST)
    high_bytes: int = 0
    high_rows: int = 0
    done: bool = False

    def nearest(self) -> tuple[Key, int, int]:
        if self.target - self.low_bytes <= self.high_bytes - self.target:
            return self.low, self.low_bytes, self.low_rows
        return self.high, self.high_bytes, self.high_rows

    def settle(self) -> None:
        away = abs(self.nearest()[1] - self.target)
        one_text = self.high[0] - self.low[0] <= 1 and self.low[1] == LOWEST and self.high[1] == LOWEST
        one_key = self.high[0] == self.low[0] and self.high[1] - self.low[1] <= 1
        one_row = self.high_rows - self.low_rows <= 1
        whole = self.low[1] == LOWEST and self.nearest()[0][1] == LOWEST
        self.done = one_row or one_key or (whole and away <= self.tolerance) or (one_text and away <= self.group_tolerance)
        self.done = self.done or (self.low[0] == self.high[0] and away <= self.tolerance)

    def probes(self, n: int) -> list[Key]:
        (h0, t0), (h1, t1) = self.low, self.high
        if h1 - h0 > 1:
            step = max(1, (h1 - h0) // (n + 1))
            return [(h, LOWEST) for h in range(h0 + step, h1, step)][: n + 1]
        top = t1 if h0 == h1 else HIGHEST  # the rows of one text, by the hash of their ids
        step = max(1, (top - t0) // (n + 1))
        return [(h0, t) for t in range(t0 + step, top, step)][: n + 1]


def _position(h: np.ndarray, t: np.ndarray, keys: list[Key]) -> np.ndarray:
    """How many of the sorted keys are at or below each (h, t)."""
    heads = np.array([key[0] for key in keys], np.int64)
    low, high = np.searchsorted(heads, h, "left"), np.searchsorted(heads, h, "right")
    for i in np.flatnonzero(low != high):
        high[i] = bisect.bisect_right(keys, (int(h[i]), int(t[i])))
    return high


def _below(sizes: DataFrame, probes: list[Key]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows below each probe, and in total as last entry. The tasks add up before anything is sent."""

    def count(batches):
        total, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for batch in batches:
            h, t, size = (np.asarray(batch.column(i)) for i in range(3))
            place = _position(h, t, probes)
            np.add.at(total, place, size)
            np.add.at(rows, place, 1)
        used = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used]), pa.array(rows[used])], ["place", "bytes", "n"])

    total, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    counted = sizes.mapInArrow(count, "place bigint, bytes bigint, n bigint").groupBy("place")
    for row in counted.agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).collect():
        total[row["place"]], rows[row["place"]] = row["bytes"], row["n"]
    return np.cumsum(total), np.cumsum(rows)


def find_splitters(sizes: DataFrame, shards: int, pieces: int, tolerance: float, group_slack: float) -> list[tuple[Key, int]]:
    """Boundaries of ``shards * pieces`` parts of ``sizes`` (h, t, size) as (key, rows below), the shards' own ones exact."""
    total, rows = (int(x[-1]) for x in _below(sizes, []))
    share, parts = total / shards, shards * pieces
    searched = [
        Splitter(
            total * i / parts,
            share * (tolerance if i % pieces == 0 else 0.25 / pieces),
            share * (group_slack if i % pieces == 0 else 0.5 / pieces),
            high_bytes=total,
            high_rows=rows,
        )
        for i in range(1, parts)
    ]
    while rows and (open_ones := [s for s in searched if not s.done]):
        each = max(3, min(255, MOST_PROBES // len(open_ones)))
        probes = sorted({key for s in open_ones for key in s.probes(each)})
        below, counts = _below(sizes, probes)
        at_bytes, at_rows = below[:-1], counts[:-1]
        for s in open_ones:
            i = int(np.searchsorted(at_bytes, s.target, "right"))
            if i and probes[i - 1] >= s.low:
                s.low, s.low_bytes, s.low_rows = probes[i - 1], int(at_bytes[i - 1]), int(at_rows[i - 1])
            if i < len(probes) and probes[i] <= s.high:
                s.high, s.high_bytes, s.high_rows = probes[i], int(at_bytes[i]), int(at_rows[i])
            s.settle()
    found, last = [], ((LOWEST, LOWEST), 0)
    for s in searched:
        key, _, below_rows = s.nearest()
        last = max(last, (key, below_rows))
        found.append(last)
    return found


def shard(
    docs: DataFrame,
    shards: int = 24,
    id: str = "doc_id",
    text: str = "text",
    tolerance: float = 0.001,
    group_slack: float = 0.02,
) -> DataFrame:
    """All rows of ``docs`` with ``shard`` (0 to shards - 1) and ``slot`` (0, 1, ... in each shard).

    A row weighs its text's UTF-8 bytes (null: none) plus 8. Each boundary is within ``tolerance`` of a shard's even share, or
    within one row where rows are larger than that. Rows that repeat an id and a text cannot be told apart by the order; they stay in one
    shard. Null ids and texts are ordered like any other value. Columns named shard or slot are replaced. With fewer rows than shards
    some shards are empty.
    """
    docs = without(docs, "shard", "slot")
    spark = docs.sparkSession
    h, t, place = fresh(docs, "_h", "_t", "_place")
    keyed = docs.withColumns({h: F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))), t: F.xxhash64(F.col(f"`{id}`"))})
    sizes = store(keyed.select(F.col(h).alias("h"), F.col(t).alias("t"), (text_bytes(F.col(f"`{text}`")) + 8).alias("size")), "sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PIECE_BYTES)
    pieces = max(1, min(-(-wanted // shards), MOST_PIECES // shards))
    splitters = find_splitters(sizes, shards, pieces, tolerance, group_slack)
    keys = [key for key, _ in splitters]
    starts = np.array([0, *[rows for _, rows in splitters]], np.int64)
    first = starts[np.arange(len(starts)) // pieces * pieces]

    @F.arrow_udf("struct<piece:int, shard:int, start:bigint>")
    def placed(head: pa.Array, tie: pa.Array) -> pa.Array:
        piece = _position(np.asarray(head), np.asarray(tie), keys)
        columns = [piece.astype(np.int32), (piece // pieces).astype(np.int32), starts[piece] - first[piece]]
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], ["piece", "shard", "start"])

    rows = keyed.withColumn(place, placed(F.col(h), F.col(t)))
    piece, start = fresh(rows, "_piece", "_start")
    rows = rows.withColumns({piece: F.col(f"{place}.piece"), "shard": F.col(f"{place}.shard"), start: F.col(f"{place}.start")}).drop(place)
    order = Window.partitionBy(piece).orderBy(h, t)
    rows = rows.repartitionById(shards * pieces, F.col(piece)).withColumn("slot", F.col(start) + F.row_number().over(order) - 1)
    return rows.drop(h, t, piece, start)
