"""Cooldown gate over a table of alerts.

An alert passes when no alert of the same key passed within the cooldown before it, so each decision depends on the last
alert that passed and not simply on the previous row. To keep one busy key from being a single task, its time line is cut
into chunks. Whatever happened before a chunk matters only through the time at which the gate reopens, and that time lies
inside the first cooldown of the chunk. Three steps follow from this:

1. every chunk works out, for each alert it might start with, the last alert that would pass (``_chunk_exits``);
2. FAN chunks at a time are put together in the same way, level by level, until one is left for each key (``_group_exits``); back down the
   levels the real start of each chunk follows from the start of its group (``_child_starts``);
3. every chunk replays from its real start.

Only distinct times take part, each with its first alert by the tie breaker: of several alerts with one key and one time exactly one
passes, also where rows are repeated as a whole. An alert without a time never passes.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidentry.functions.clock import micros
from incidentry.operators.joins import lookup_join
from incidentry.session import settle

CHUNK_COOLDOWNS = 24
CALM_TIMES = 1000
KEY_BYTES = 16  # of the 32 of a key's SHA-256, which is most of what is shuffled
FAN = 64


def alert_key(*parts: str) -> Column:
    """Hash of all parts, each with its length in front, so that no two lists of parts run together; null has a mark of its own."""
    texts = [F.col(part).cast("string") for part in parts]
    marked = [F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")) for text in texts]
    return F.sha2(F.concat_ws(",", *marked), 256)


def _chunk_exits(cooldown: int, length: int):
    def exits(group: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(group["at"].to_numpy())
        following = np.searchsorted(times, times + cooldown)
        last = np.arange(len(times))
        while True:  # as many rounds as alerts can pass in one chunk
            target = following[last]
            inside = target < len(times)
            if not inside.any():
                break
            last = np.where(inside, target, last)
        begin = group["chunk"].iloc[0] * length
        candidates = min(np.searchsorted(times, begin + cooldown) + 1, len(times))
        return pd.DataFrame(
            {
                "key": group["key"].iloc[0],
                "chunk": group["chunk"].iloc[0],
                "entry": times[:candidates],
                "exit": times[last[:candidates]],
            }
        )

    return exits


def _by_chunk(group: pd.DataFrame) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(chunk, entries, exits) of the chunks of one group, in order."""
    group = group.sort_values(["chunk", "entry"])
    chunks, first = np.unique(group["chunk"].to_numpy(), return_index=True)
    entries, exits = group["entry"].to_numpy(), group["exit"].to_numpy()
    ends = np.append(first[1:], len(entries))
    return [(chunk, entries[low:high], exits[low:high]) for chunk, low, high in zip(chunks, first, ends)]


def _group_exits(cooldown: int):
    """Chunks of one group -> the group as one chunk: where it may be entered, and the last alert that passes then."""

    def exits(group: pd.DataFrame) -> pd.DataFrame:
        chunks = _by_chunk(group)
        entry, last = chunks[0][1], chunks[0][2]
        if len(chunks) > 1:  # the first chunk may have nothing after the gate reopens; the second is then entered at its start
            entry = np.append(entry, chunks[1][1][0])
            last = np.append(last, chunks[1][2][0])
        for place, (_, entries, ends) in enumerate(chunks[1:], 1):
            at = np.searchsorted(entries, last + cooldown)
            moved = np.where(at < len(entries), ends[np.minimum(at, len(entries) - 1)], last)
            if place == 1 and len(chunks) > 1:
                moved[-1] = last[-1]
            last = moved
        key, number = group["key"].iloc[0], group["group"].iloc[0]
        return pd.DataFrame({"key": key, "chunk": number, "entry": entry, "exit": last}).drop_duplicates("entry")

    return exits


def _child_starts(cooldown: int):
    """Chunks of one group with the start of the group -> the start of each chunk in which an alert passes."""

    def starts(group: pd.DataFrame) -> pd.DataFrame:
        opens, found = int(group["start"].iloc[0]), []
        for chunk, entries, exits in _by_chunk(group):
            place = np.searchsorted(entries, opens)
            if place < len(entries):
                found.append((chunk, entries[place]))
                opens = exits[place] + cooldown
        return pd.DataFrame(found, columns=["chunk", "start"]).assign(key=group["key"].iloc[0])[["key", "chunk", "start"]]

    return starts


def _fold(times: str, cooldown: int, opens: Column) -> Column:
    """Alerts (at, first) that pass out of a sorted list, the first one not before ``opens``."""
    none = F.array().cast("array<struct<at:bigint,first:string>>")
    begin = F.struct(opens.alias("opens"), none.alias("passed"))

    def step(state: Column, alert: Column) -> Column:
        passed = F.struct((alert["at"] + cooldown).alias("opens"), F.concat(state["passed"], F.array(alert)).alias("passed"))
        return F.when(alert["at"] >= state["opens"], passed).otherwise(state)

    return F.aggregate(times, begin, step, lambda state: state["passed"])


def _listed(times: DataFrame, *keys: str) -> DataFrame:
    return times.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "first"))).alias("times"))


def _grouped(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("group", F.floor(F.col("chunk") / F.lit(FAN)).cast("bigint"))


def _busy_passing(times: DataFrame, cooldown: int, chunk_cooldowns: int) -> DataFrame:
    length = cooldown * chunk_cooldowns
    cut = times.withColumn("chunk", F.floor(F.col("at") / F.lit(length)).cast("bigint"))
    kind = times.schema["key"].dataType.simpleString()
    shape = f"key {kind}, chunk bigint, entry bigint, exit bigint"
    levels = [settle(cut.groupBy("key", "chunk").applyInPandas(_chunk_exits(cooldown, length), shape))]
    low, high = levels[0].agg(F.min("chunk"), F.max("chunk")).first()
    while low != high:
        levels.append(settle(_grouped(levels[-1]).groupBy("key", "group").applyInPandas(_group_exits(cooldown), shape)))
        low, high = low // FAN, high // FAN
    starts = levels[-1].groupBy("key", "chunk").agg(F.min("entry").alias("start"))
    for below in reversed(levels[:-1]):
        known = _grouped(below).join(starts.withColumnRenamed("chunk", "group"), ["key", "group"])
        starts = known.groupBy("key", "group").applyInPandas(_child_starts(cooldown), f"key {kind}, chunk bigint, start bigint")
    replayed = _listed(cut, "key", "chunk").join(starts, ["key", "chunk"])
    return replayed.select("key", F.inline(_fold("times", cooldown, F.col("start"))))


def passing_times(
    times: DataFrame, cooldown_seconds: int, chunk_cooldowns: int = CHUNK_COOLDOWNS, calm_times: int = CALM_TIMES
) -> DataFrame:
    """``times(key, at, first)``, one row per key and time in microseconds -> the rows at which the gate lets an alert through.

    A key with at most ``calm_times`` times is one short list; the others are counted first and cut into chunks. They are counted by a short
    hash of the key, and keys that share one are cut alike.
    """
    cooldown = cooldown_seconds * 1_000_000
    hashed = F.xxhash64("key").alias("hash")
    counts = times.groupBy(hashed).agg(F.count(F.lit(1)).alias("n"))
    busy = settle(counts.where(F.col("n") > calm_times).select("hash", F.lit(True).alias("busy")))
    always = F.lit(-(1 << 62)).cast("bigint")
    if busy.isEmpty():
        return _listed(times, "key").select("key", F.inline(_fold("times", cooldown, always)))
    marked = lookup_join(times.select("*", hashed), busy, "hash", "at").drop("hash")
    calm = _listed(marked.where("busy is null"), "key").select("key", F.inline(_fold("times", cooldown, always)))
    return calm.unionByName(_busy_passing(marked.where("busy").drop("busy"), cooldown, chunk_cooldowns))


def _with_tie(df: DataFrame, tie: str) -> DataFrame:
    """The tie breaker as text, and whether there is one, neither null."""
    text = F.col(tie).cast("string")
    return df.withColumns({"_tie": F.coalesce(text, F.lit("")), "_tied": text.isNotNull()})


def with_gate(
    df: DataFrame,
    key_parts: Sequence[str],
    time: str,
    tie: str,
    cooldown_seconds: int = 3600,
    chunk_cooldowns: int = CHUNK_COOLDOWNS,
    calm_times: int = CALM_TIMES,
) -> DataFrame:
    """Add ``allowed``: whether the gate lets the alert through. Of rows with one key and time the smallest ``tie`` passes, once."""
    keyed = df.withColumns({"_key": F.substring(F.unhex(alert_key(*key_parts)), 1, KEY_BYTES), "_at": micros(time)})
    if cooldown_seconds <= 0:
        return keyed.withColumn("allowed", F.col("_at").isNotNull()).drop("_key", "_at")
    timed = keyed.where("_at is not null").groupBy(F.col("_key").alias("key"), F.col("_at").alias("at"))
    times = settle(timed.agg(F.min(tie).cast("string").alias("first")))
    passed = passing_times(times, cooldown_seconds, chunk_cooldowns, calm_times)
    place = ["_key", "_at", "_tie", "_tied"]  # plain equality, so that the join and the window share one exchange
    winners = _with_tie(passed.select(F.col("key").alias("_key"), F.col("at").alias("_at"), "first"), "first").select(*place, F.lit(True).alias("_passed"))
    joined = _with_tie(keyed, tie).join(winners, place, "left")
    repeats = Window.partitionBy(*place).orderBy(F.lit(1))
    allowed = F.coalesce(F.col("_passed") & (F.row_number().over(repeats) == 1), F.lit(False))
    return joined.withColumn("allowed", allowed).select(*[f"`{name}`" for name in df.columns if name != "allowed"], "allowed")
