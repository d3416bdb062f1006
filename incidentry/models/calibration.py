"""Calibrated probabilities: isotonic regression of labels on scores, fitted on other folds only, and reliability tables.

Scores count at DIGITS digits, so a table of any size is first summed to at most 10^DIGITS + 1 levels for each fold. Adjacent levels that fall
are pooled inside RANGES ranges of scores, and what is left of these is pooled again for each fold.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidentry.functions.common import as_column

DIGITS, RANGES = 4, 64
LEVELS = 10**DIGITS
BLOCK = "fold int, low int, hits double, n double"


def level(score: str | Column) -> Column:
    """The score as a whole number of steps of 10^-DIGITS, scores outside 0 to 1 at the ends."""
    steps = F.round(as_column(score) * LEVELS)
    return F.when(steps.isNotNull(), F.least(F.greatest(steps, F.lit(0)), F.lit(LEVELS))).cast("int")


def pooled(low: np.ndarray, hits: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adjacent rows, in order, pooled until their rates rise: first level, hits and number of each block."""
    starts, sums, counts = [], [], []
    for a, h, m in zip(low.tolist(), hits.tolist(), n.tolist()):
        while sums and sums[-1] * m >= h * counts[-1]:  # the block before has no lower rate
            a, h, m = starts.pop(), h + sums.pop(), m + counts.pop()
        starts.append(a)
        sums.append(h)
        counts.append(m)
    return np.array(starts, np.int32), np.array(sums), np.array(counts)


def _pool(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("low")
    low, hits, n = pooled(rows["low"].to_numpy(), rows["hits"].to_numpy(), rows["n"].to_numpy())
    return pd.DataFrame({"fold": rows["fold"].iloc[0], "low": low, "hits": hits, "n": n})


def isotonic(scored: DataFrame, score: str = "probability", label: str = "label", fold: str | None = None) -> DataFrame:
    """(fold, low, hits, n, rate): blocks of rising rates by first level. The blocks of a fold come from the rows of all others.

    Without ``fold`` there is one fold, null, fitted on all rows. Rows whose score, label or fold is null are left out. A single fold has
    no others and gets no blocks.
    """
    number = F.lit(None).cast("int") if fold is None else F.col(fold).cast("int")
    rows = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    if fold is not None:
        rows = rows.where(F.col(fold).isNotNull())
    levels = rows.groupBy(number.alias("fold"), level(score).alias("low")).agg(F.sum(F.col(label).cast("double")).alias("hits"), F.count(F.lit(1)).cast("double").alias("n"))
    if fold is not None:
        every = levels.groupBy("low").agg(F.collect_list(F.struct("fold", "hits", "n")).alias("each"))  # an entry for each fold
        folds = sorted(row["fold"] for row in levels.select("fold").distinct().collect())
        rows = every.withColumn("fold", F.explode(F.array(*[F.lit(number) for number in folds]).cast("array<int>")))
        rows = rows.withColumn("rest", F.filter("each", lambda e: e["fold"] != F.col("fold"))).where(F.size("rest") > 0)
        levels = rows.select("fold", "low", *[F.aggregate(F.col(f"rest.{name}"), F.lit(0.0), lambda a, b: a + b).alias(name) for name in ("hits", "n")])
    ranges = levels.withColumn("range", F.floor(F.col("low") * RANGES / (LEVELS + 1)).cast("int"))
    inside = ranges.groupBy("fold", "range").applyInPandas(lambda rows: _pool(rows), BLOCK)
    blocks = inside.groupBy("fold").applyInPandas(_pool, BLOCK)
    return blocks.withColumn("rate", F.col("hits") / F.col("n"))


def calibrated(scored: DataFrame, score: str = "probability", label: str = "label", fold: str | None = None, name: str = "calibrated") -> DataFrame:
    """``scored`` with the rate of the block that a row's score falls in, for its fold; scores below all blocks get the first one's.

    Rows without a score, or of a fold without blocks, have null.
    """
    blocks = isotonic(scored, score, label, fold)
    order = Window.partitionBy("fold").orderBy("low")
    first = F.when(F.row_number().over(order) == 1, F.lit(0)).otherwise(F.col("low"))
    end = F.coalesce(F.lead("low").over(order), F.lit(LEVELS + 1)) - 1
    steps = blocks.select(F.col("fold").alias("_fold"), "rate", first.alias("_first"), end.alias("_end"))
    steps = steps.select("_fold", F.col("rate").alias(name), F.explode(F.sequence("_first", "_end")).alias("_level"))
    # every level once for each fold, which bounds the broadcast
    same = F.col("_at") == F.col("_level")
    if fold is not None:
        same = same & (F.col(fold) == F.col("_fold"))
    return scored.drop(name).withColumn("_at", level(score)).join(F.broadcast(steps), same, "left").drop("_at", "_level", "_fold")


def reliability(scored: DataFrame, score: str = "probability", label: str = "label") -> DataFrame:
    """By tenth of the rows in order of score: rows, mean score, rate of label 1, and how far they are apart.

    Equal levels of score are in one tenth, that of the first of them. Rows without a score or label are left out.
    """
    rows = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    levels = rows.groupBy(level(score).alias("low")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(score).cast("double")).alias("scores"), F.sum(F.col(label).cast("bigint")).alias("hits")
    )  # at most LEVELS + 1 rows from here on
    before = F.coalesce(F.sum("n").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("n").over(Window.partitionBy())
    tenths = levels.withColumn("tenth", F.floor(before * 10 / whole).cast("int"))
    table = tenths.groupBy("tenth").agg(
        F.sum("n").alias("rows"), (F.sum("scores") / F.sum("n")).alias("mean_score"), (F.sum("hits") / F.sum("n")).alias("rate")
    )
    return table.withColumn("apart", F.abs(F.col("mean_score") - F.col("rate")))
