"""Running sums and percentiles over any number of rows.

A window over a whole key, or over no key at all, is read by one task. Here order-preserving buckets split each key: running
sums are taken inside a bucket, and the sum of the buckets before it is added. Buckets come in levels, a fine one inside each
coarse one, so that a coarse bucket with very many rows is split again and no level gathers more than its own bucket sums.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidentry.functions.clock import MICROS_PER_HOUR, micros
from incidentry.functions.common import as_column
from incidentry.session import settle

BUCKETS = 65_536
SKETCH_MARGIN, FEW_ROWS = 1e-4, 10_000
NULL_TIME_HOUR = 1 << 40  # later than any hour number
TIE_BLOCK_BITS = 20


def _starts(sums: DataFrame, by: list[str], levels: list[str], names: Sequence[str], totals: Mapping[str, str]) -> DataFrame:
    """Bucket sums -> sums over all earlier buckets of the same key, level by level."""
    outer, last = [*by, *levels[:-1]], levels[-1]
    earlier = Window.partitionBy(*outer).orderBy(last).rowsBetween(Window.unboundedPreceding, -1)
    within = [F.coalesce(F.sum(f"_sum_{name}").over(earlier), F.lit(0)).alias(f"_start_{name}") for name in names]
    if len(levels) == 1:
        whole_key = Window.partitionBy(*by)
        whole = [F.sum(f"_sum_{name}").over(whole_key).alias(total) for name, total in totals.items()]
        return sums.select(*by, last, *within, *whole)
    coarse = sums.groupBy(*outer).agg(*[F.sum(f"_sum_{name}").alias(f"_sum_{name}") for name in names])
    before = _starts(coarse, by, levels[:-1], names, totals)
    for name in names:
        before = before.withColumnRenamed(f"_start_{name}", f"_outer_{name}")
    joined = sums.select(*outer, last, *within).join(before, outer)
    return joined.withColumns({f"_start_{name}": F.col(f"_start_{name}") + F.col(f"_outer_{name}") for name in names}).drop(
        *[f"_outer_{name}" for name in names]
    )


def running_sums(
    df: DataFrame,
    order: Sequence[Column],
    buckets: Sequence[Column],
    sums: Mapping[str, Column],
    by: Sequence[str] = (),
    totals: Mapping[str, str] | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Add, for every row, the sums over the rows before it in ``order``; ``totals`` names columns for the whole-key sums.

    ``buckets`` are the levels, coarse first. None may be null, and along ``order`` none may decrease inside the level above.
    Rows with a null key get nulls. ``counted`` may be an earlier table with the same rows, which is cheaper to read for the
    bucket sums.
    """
    by, names = list(by), list(sums)
    levels = [f"_bucket{i}" for i in range(len(buckets))]
    part = [*by, *levels]
    placed = dict(zip(levels, buckets))
    keyed = df.withColumns(placed)
    source = keyed if counted is None else counted.withColumns(placed)
    bucket_sums = source.groupBy(*part).agg(*[F.sum(value).alias(f"_sum_{name}") for name, value in sums.items()])
    starts = _starts(bucket_sums, by, levels, names, dict(totals or {}))
    before_row = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = keyed.withColumns(
        {name: F.coalesce(F.sum(value).over(before_row), F.lit(0)) for name, value in sums.items()}
    )
    joined = inside.join(starts, part, "left")
    return joined.withColumns({name: F.col(name) + F.col(f"_start_{name}") for name in names}).drop(
        *levels, *[f"_start_{name}" for name in names]
    )


def time_buckets(time: str | Column, tie: str | Column) -> list[Column]:
    """Levels for the order time, tie: the hour, then the exact time with a block of the whole-number tie breaker.

    Rows without a time come last.
    """
    at = micros(time)
    hour = F.floor(at / F.lit(float(MICROS_PER_HOUR))).cast("bigint")
    block = F.shiftright(as_column(tie).cast("bigint"), TIE_BLOCK_BITS)
    return [
        F.coalesce(hour, F.lit(NULL_TIME_HOUR)),
        F.struct(F.coalesce(at, F.lit(0).cast("bigint")).alias("at"), F.coalesce(block, F.lit(0).cast("bigint")).alias("block")),
    ]


def hash_bucket(hashed: str | Column) -> Column:
    """Upper 16 bits of a 64-bit hash, in the order of the hash."""
    return F.shiftright(as_column(hashed), 48).cast("bigint")


def share_buckets(portion: Column) -> list[Column]:
    """Two levels for a number between 0 and 1."""
    place = portion * F.lit(BUCKETS - 1.0)
    return [F.floor(place).cast("bigint"), F.floor((place - F.floor(place)) * F.lit(float(BUCKETS))).cast("bigint")]


@dataclass
class _Rank:
    """The value with ``rank`` others before it in ``column``, known to lie from low to high."""

    column: str
    rank: int
    low: float = float("-inf")
    high: float = float("inf")
    below: int = 0
    inside: int = 0
    value: float | None = None


def _counted(values: DataFrame, ranges: Sequence[tuple[str, float, float]]) -> list[tuple[int, int]]:
    """Rows below and inside each range (column, low, high)."""
    if not ranges:
        return []
    sums = []
    for i, (column, low, high) in enumerate(ranges):
        v = F.col(column)
        sums += [F.count_if(v < low).alias(f"b{i}"), F.count_if((v >= low) & (v <= high)).alias(f"n{i}")]
    row = values.agg(*sums).first()
    return [(row[f"b{i}"], row[f"n{i}"]) for i in range(len(ranges))]


def _brackets(values: DataFrame, ranks: Sequence[_Rank]) -> list[tuple[float, float]]:
    """A narrow range around each rank, by mergeable sketches over what is left of its range."""
    wanted = []
    for i, r in enumerate(ranks):
        v = F.col(r.column)
        share = (r.rank - r.below) / max(1, r.inside - 1)
        inside = F.when((v >= r.low) & (v <= r.high), v)
        ends = [max(0.0, share - SKETCH_MARGIN), min(1.0, share + SKETCH_MARGIN)]
        wanted.append(F.percentile_approx(inside, ends, int(2 / SKETCH_MARGIN)).alias(f"p{i}"))
    row = values.agg(*wanted).first()
    return [(float(row[f"p{i}"][0]), float(row[f"p{i}"][1])) for i in range(len(ranks))]


def _found(values: DataFrame, ranks: Sequence[_Rank]) -> None:
    """Narrow all ranges until a few rows are left in each, then read these."""
    for r, (below, inside) in zip(ranks, _counted(values, [(r.column, r.low, r.high) for r in ranks])):
        r.below, r.inside = below, inside
    while open_ranks := [r for r in ranks if r.inside > FEW_ROWS and r.low < r.high]:
        brackets = _brackets(values, open_ranks)
        for r, (low, high), (below, inside) in zip(open_ranks, brackets, _counted(values, [(r.column, *b) for r, b in zip(open_ranks, brackets)])):
            v = F.col(r.column)
            if (low, high) == (r.low, r.high):  # the ends are there too often for a sketch to tell them apart
                ties, following = values.agg(F.count_if(v == low), F.min(F.when(v > low, v))).first()
                if r.rank < r.below + ties:
                    r.high = low
                else:
                    r.low, r.below, r.inside = following, r.below + ties, r.inside - ties
            elif r.rank < below:
                r.high = low
                r.inside = _counted(values, [(r.column, r.low, r.high)])[0][1]
            elif r.rank >= below + inside:
                r.low = high
                r.below, r.inside = _counted(values, [(r.column, r.low, r.high)])[0]
            else:
                r.low, r.high, r.below, r.inside = low, high, below, inside
    for r in ranks:
        if r.low == r.high:
            r.value = r.low
    few = [(i, r) for i, r in enumerate(ranks) if r.value is None]
    picked = [F.when((F.col(r.column) >= r.low) & (F.col(r.column) <= r.high), F.struct(F.lit(i).alias("i"), F.col(r.column).alias("v"))) for i, r in few]
    if picked:
        rows = values.select(F.explode(F.array_compact(F.array(*picked))).alias("c")).select("c.i", "c.v").collect()  # FEW_ROWS a rank
        for i, r in few:
            r.value = sorted(row["v"] for row in rows if row["i"] == i)[r.rank - r.below]


def exact_percentiles(df: DataFrame, wanted: Mapping[str, tuple[str, float]]) -> DataFrame:
    """One row with linearly interpolated percentiles of whole columns: output name -> (column, share).

    Nothing is sorted or shuffled by value: sketches narrow a range around each rank, exact counts confirm it, and the last FEW_ROWS rows
    are read. One row far from the others changes nothing. Null and NaN are left out; a column without values gives null.
    """
    columns = list(dict.fromkeys(column for column, _ in wanted.values()))
    names = {column: f"v{i}" for i, column in enumerate(columns)}
    values = settle(df.select(*[F.nanvl(F.col(column).cast("double"), F.lit(None)).alias(names[column]) for column in columns]))
    sizes = values.agg(*[F.count(name).alias(name) for name in names.values()]).first()
    ranks: dict[tuple[str, int], _Rank] = {}
    places = {}
    for output, (column, share) in wanted.items():
        name = names[column]
        place = share * (sizes[name] - 1)
        places[output] = (name, place)
        for rank in {math.floor(place), math.ceil(place)} if sizes[name] else ():
            ranks.setdefault((name, rank), _Rank(name, rank))
    if ranks:
        _found(values, list(ranks.values()))
    row = []
    for name, place in places.values():
        if not sizes[name]:
            row.append(None)
            continue
        low, high = ranks[name, math.floor(place)].value, ranks[name, math.ceil(place)].value
        row.append(low + (high - low) * (place - math.floor(place)))
    return df.sparkSession.createDataFrame([tuple(row)], ", ".join(f"`{output}` double" for output in wanted))
