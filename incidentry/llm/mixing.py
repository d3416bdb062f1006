"""Mixing sources to target weights by temperature.

Weights are token shares raised to an exponent, which is bisected until the mixture has the wanted entropy or repeats no source
more often than allowed. Each source then has a budget of tokens: whole passes over its documents, and one pass that ends where the
budget does. A pass goes through the blocks of a source in an order of its own. Where the last pass ends is found by summing blocks,
then ever smaller parts of the block in which the budget runs out, so that no source is ever sorted or gathered.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidentry.llm.common import bytes_of, fresh, store, without

BLOCK_BITS, LOW_BITS, STEP_BITS = 8, 56, 8
SECTIONS, ROUNDS = 64, 5
SEED = 7


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; none for null."""

    @F.arrow_udf("bigint")
    def counted(values: pa.Array) -> pa.Array:
        return pa.array([len((data or b"").split()) for data in bytes_of(values)], pa.int64())

    return counted(text)


def _group(source: Column) -> Column:
    """A source as a text that is never null."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), source.cast("string")))


def exponent(shares: DataFrame, entropy: float | None = None, repetitions: float | None = None) -> float:
    """The largest exponent in [0, 1] whose weights reach the entropy (in nats), or the smallest that keeps to the repetition limit.

    With both, the limit comes first. ``shares`` has one row per source with a positive ``share``. Each round sums SECTIONS candidates
    in one pass; an entropy out of reach gives the nearest end.
    """
    low, high = 0.0, 1.0
    if repetitions is not None:
        ends = shares.agg(F.min("share").alias("low"), F.max("share").alias("high")).first()
        ratio = math.log(ends["high"] / ends["low"]) if ends["low"] else 0.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if ratio * (1 - middle) > math.log(max(1.0, repetitions)) else (low, middle)
        least = 0.0 if ratio <= math.log(max(1.0, repetitions)) else high
    else:
        least = 0.0
    if entropy is None:
        return least if repetitions is not None else 1.0
    low, high = least, 1.0
    for _ in range(ROUNDS):
        tried = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
        power = [F.pow("share", F.lit(a)) for a in tried]
        sums = [F.sum(x).alias(f"z{i}") for i, x in enumerate(power)] + [F.sum(x * F.log("share")).alias(f"s{i}") for i, x in enumerate(power)]
        row = shares.agg(*sums).first()
        if row["z0"] is None:
            return high
        reached = [i for i, a in enumerate(tried) if math.log(row[f"z{i}"]) - a * row[f"s{i}"] / row[f"z{i}"] >= entropy]
        if not reached:
            return low
        last = max(reached)
        if last == SECTIONS:
            return high
        low, high = tried[last], tried[last + 1]
    return low


def _narrow(docs: DataFrame, id: str, text: str, source: str, tokens: Column, seed: int) -> DataFrame:
    return docs.withColumns(_place(docs, id, text, source, seed)).select("_g", "_block", "_low", tokens.alias("tokens"))


def _place(docs: DataFrame, id: str, text: str, source: str, seed: int) -> dict[str, Column]:
    u = F.xxhash64(F.lit(seed), F.col(f"`{id}`"), F.col(f"`{text}`"))
    return {
        "_g": _group(F.col(f"`{source}`")),
        "_block": F.shiftrightunsigned(u, LOW_BITS).cast("int"),
        "_low": u.bitwiseAND(F.lit((1 << LOW_BITS) - 1)),
    }


def _turn(group: Column | str, copy: Column | str, block: Column | str, seed: int) -> Column:
    """Where a block comes in a pass over its source."""
    return F.xxhash64(F.lit(seed), group, copy, block)


def weights(narrow: DataFrame, entropy: float | None, repetitions: float | None, budget: float | None) -> DataFrame:
    """One row per source: _g, total, share, weight, wanted (tokens), passes (whole ones), rest (tokens of the last pass).

    Without a budget the mixture is as long as it takes to read every source at least once. Sources without tokens are read once.
    """
    totals = store(narrow.groupBy("_g").agg(F.sum("tokens").alias("total"), F.count(F.lit(1)).alias("rows")), "totals")
    whole = totals.agg(F.sum("total")).first()[0] or 0
    shares = totals.where("total > 0").select("_g", (F.col("total") / F.lit(float(max(whole, 1)))).alias("share"))
    a = exponent(shares, entropy, repetitions)
    ends = shares.agg(F.sum(F.pow("share", F.lit(a))).alias("z"), F.max(F.pow("share", F.lit(1 - a))).alias("m")).first()
    norm, slowest = ends["z"] or 1.0, ends["m"] or 1.0
    length = budget if budget is not None else whole * norm * slowest
    rows = totals.join(shares, "_g", "left").withColumn("weight", F.coalesce(F.pow("share", F.lit(a)) / norm, F.lit(0.0)))
    wanted = F.when(F.col("total") > 0, F.round(F.col("weight") * length).cast("bigint")).otherwise(0)
    rows = rows.withColumn("wanted", wanted).withColumn("exponent", F.lit(a))
    passes = F.when(F.col("total") > 0, F.floor(F.col("wanted") / F.col("total"))).otherwise(1).cast("int")
    rows = rows.withColumn("passes", passes)
    return store(rows.withColumn("rest", F.greatest(F.lit(0), F.col("wanted") - F.col("passes") * F.col("total"))), "weights")


def _cuts(narrow: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """One row per source with a part of a pass: _g, cut_turn, cut_low. The last pass takes blocks before ``cut_turn``, and of that block rows below ``cut_low``."""
    turns = narrow.groupBy("_g", "_block").agg(F.sum("tokens").alias("part"), F.count(F.lit(1)).alias("n"))
    turns = turns.join(sources.where("rest > 0").select("_g", "passes", "rest"), "_g").withColumn("turn", _turn("_g", "passes", "_block", seed))
    cut = _boundary(turns, "turn").select("_g", F.col("turn").alias("cut_turn"), "_block", F.lit(0).cast("bigint").alias("cut_low"), "rest", "n")
    cut = store(cut, "cuts")
    for done in range(STEP_BITS, LOW_BITS + 1, STEP_BITS):
        if (cut.agg(F.max("n")).first()[0] or 0) <= 1:
            break
        shift = LOW_BITS - done
        held = narrow.join(cut.withColumnRenamed("cut_low", "at").select("_g", "_block", "cut_turn", "at", "rest"), ["_g", "_block"])
        inside = F.shiftrightunsigned(F.col("_low"), shift + STEP_BITS) == F.shiftrightunsigned(F.col("at"), shift + STEP_BITS)
        part = F.shiftleft(F.shiftrightunsigned(F.col("_low"), shift), shift).alias("start")
        parts = held.where(inside).groupBy("_g", "_block", "cut_turn", "rest", part).agg(F.sum("tokens").alias("part"), F.count(F.lit(1)).alias("n"))
        cut = store(_boundary(parts, "start").select("_g", "cut_turn", "_block", F.col("start").alias("cut_low"), "rest", "n"), "cuts")
    return cut.select("_g", "cut_turn", "cut_low")


def _boundary(parts: DataFrame, order: str) -> DataFrame:
    """The part of each source, of at most 256, in which the rest of its budget runs out, with what is left of the rest there."""
    run = Window.partitionBy("_g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ended = parts.withColumn("sum", F.sum("part").over(run)).where(F.col("sum") > F.col("rest"))
    first = F.row_number().over(Window.partitionBy("_g").orderBy(order))
    found = ended.withColumn("nth", first).where("nth = 1")
    return found.withColumn("rest", F.col("rest") - (F.col("sum") - F.col("part"))).drop("sum", "nth")


def mix(
    docs: DataFrame,
    entropy: float | None = None,
    repetitions: float | None = None,
    budget: float | None = None,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    tokens: Column | None = None,
    seed: int = SEED,
    ordered: bool = True,
) -> DataFrame:
    """Rows of ``docs``, each as often as its source's weight asks for, with ``copy`` (0, 1, ...), ``weight`` and ``position``.

    ``position`` in [0, 1) is where a copy stands in the mixture; read in its order, sources keep to their weights all along. Whole passes
    come first and the budget is never exceeded, by less than one document unused. A null source is a source of its own; empty texts have no tokens
    and come with their pass. Rows that repeat an id and a text are taken together. Columns with the name of a result column are replaced.
    ``ordered=False`` leaves out ``position``.
    """
    docs = without(docs, "copy", "weight", "position")
    taken = [name for name in docs.columns if name.lower() in ("_g", "_block", "_low", "cut_turn", "cut_low", "passes", "total")]
    if taken:
        names = dict(zip(taken, fresh(docs, *[f"_{name}" for name in taken])))
        back = {new: old for old, new in names.items()}
        renamed = docs.withColumnsRenamed(names)
        at = [names.get(name, name) for name in (id, text, source)]
        return mix(renamed, entropy, repetitions, budget, *at, tokens, seed, ordered).withColumnsRenamed(back)
    counted = tokens if tokens is not None else word_count(F.col(f"`{text}`"))
    narrow = store(_narrow(docs, id, text, source, counted, seed), "token-counts")
    sources = weights(narrow, entropy, repetitions, budget)
    cuts = store(sources.select("_g", "passes", "weight", "wanted").join(_cuts(narrow, sources, seed), "_g", "left"), "plan")
    rows = docs.withColumns(_place(docs, id, text, source, seed)).join(cuts, "_g")  # a row per source
    turn = _turn("_g", "passes", "_block", seed)
    in_last = (turn < F.col("cut_turn")) | ((turn == F.col("cut_turn")) & (F.col("_low") < F.col("cut_low")))
    copies = F.col("passes") + F.coalesce(in_last, F.lit(False)).cast("int")
    rows = rows.withColumn("copy", F.explode(F.when(copies > 0, F.sequence(F.lit(0), copies - 1)))).drop("passes", "cut_turn", "cut_low")
    if ordered:
        starts = _starts(narrow, sources, seed)
        rows = rows.join(starts, ["_g", "_block", "copy"])
        inside = F.col("_low") / F.lit(float(1 << LOW_BITS)) * F.col("_part")
        place = (F.col("_before") + inside) / F.greatest(F.col("wanted"), F.lit(1))
        rows = rows.withColumn("position", F.least(place, F.lit(1 - 1e-12))).drop("_before", "_part")
    columns = [F.col(f"`{name}`") for name in docs.columns]
    return rows.select(*columns, "copy", "weight", *(["position"] if ordered else []))


def _starts(narrow: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Tokens of a source before each of its blocks (at most 256) in each pass."""
    blocks = narrow.groupBy("_g", "_block").agg(F.sum("tokens").alias("_part"))
    passes = blocks.join(sources.select("_g", "total", "passes"), "_g").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("passes"))))
    run = Window.partitionBy("_g", "copy").orderBy(_turn("_g", "copy", "_block", seed)).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_part").over(run), F.lit(0)) + F.col("copy") * F.col("total")
    return store(passes.select("_g", "_block", "copy", before.alias("_before"), "_part"), "starts")
