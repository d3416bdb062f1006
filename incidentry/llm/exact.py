"""Exact duplicates by distributed MSD radix partitioning.

Documents are split by successive bytes. Digits widen from level to level (bytes 0-15, then to 256, 4096, ...). Counts decide where
the recursion goes on: a group of more than 1/1024 of the rows is split by its next digit, a smaller one is handed to one task, where
Spark's spilling sort takes its remaining bytes. A large group whose texts have ended holds one text only; its size and largest id are
known from the counts, so its rows are spread by id and never meet. Equality is that of whole byte strings, no digest is used.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from incidentry.llm.common import bytes_of, fresh, without

FIRST_DIGIT, WIDEN = 16, 16
LARGE_SHARE, LARGE_ROWS = 1024, 1000
SALTS = 1024

Node = tuple[bytes, bool]  # leading bytes, and whether the text ends within them


def _leaf(data: bytes, large: dict[Node, int]) -> tuple[Node, int]:
    """The first group on a text's path that is not large, or the large one in which it ends; with the level."""
    end, level = FIRST_DIGIT, 0
    while True:
        node = (data[:end], len(data) <= end)
        if node not in large or node[1]:
            return node, level
        end, level = end * WIDEN, level + 1


def _lowered(values: pa.Array) -> pa.Array:
    return pc.fill_null(pc.ascii_lower(values), "")


def _large_groups(docs: DataFrame, id: str, text: str, limit: int) -> tuple[dict[Node, int], list]:
    """Groups over the limit, level by level, and (group size, largest id) of those that have ended. At most 1024 a level."""
    large: dict[Node, int] = {}
    ended: list = []
    level = 0
    while True:

        def count(batches, large=dict(large), level=level):
            for batch in batches:
                sizes: Counter = Counter()
                for data in bytes_of(_lowered(batch.column(0))):
                    node, at = _leaf(data, large)
                    if at == level and node not in large:
                        sizes[node] += 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([node[0] for node in sizes], pa.binary()),
                        pa.array([node[1] for node in sizes], pa.bool_()),
                        pa.array(list(sizes.values()), pa.int64()),
                    ],
                    ["lead", "ended", "n"],
                )

        counts = docs.select(text).mapInArrow(count, "lead binary, ended boolean, n bigint")
        found = counts.groupBy("lead", "ended").agg(F.sum("n").alias("n")).where(F.col("n") > limit).collect()
        open_groups = 0
        for row in found:
            large[(bytes(row["lead"]), row["ended"])] = -1
            open_groups += not row["ended"]
        if not open_groups:
            break
        level += 1
    texts = [node for node in large if node[1]]
    for place, node in enumerate(texts):
        large[node] = place
    if texts:

        @F.arrow_udf("int")
        def which(values: pa.Array) -> pa.Array:
            return pa.array([large.get(_leaf(data, large)[0], -1) for data in bytes_of(_lowered(values))], pa.int32())

        totals = docs.select(which(F.col(f"`{text}`")).alias("place"), F.col(f"`{id}`").alias("id")).where("place >= 0")
        ended = totals.groupBy("place").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n")).collect()
    return large, ended


def exact_groups(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows of ``docs`` with ``normalised`` (A-Z in lower case), ``keep_id``, ``group_size`` and ``kept``.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty. ``keep_id`` is the largest id of the group
    (null if the group has none), and exactly one row stays: of rows that repeat that id, any one of them. Input columns with the
    name of a result column are replaced. An empty table gives an empty result.
    """
    docs = without(docs, "normalised", "keep_id", "group_size", "kept")
    limit = max(LARGE_ROWS, docs.count() // LARGE_SHARE)
    large, ended = _large_groups(docs, id, text, limit)
    lead, salt, place, known_keep, known_n, rank = fresh(docs, "_lead", "_salt", "_place", "_known_keep", "_known_n", "_rank")

    @F.arrow_udf("struct<normalised:string, lead:binary, place:int>")
    def split(values: pa.Array) -> pa.Array:
        lowered = _lowered(values)
        leaves = [_leaf(data, large)[0] for data in bytes_of(lowered)]
        places = [large.get(node, -1) for node in leaves]
        leads = [node[0] for node in leaves]
        return pa.StructArray.from_arrays(
            [lowered, pa.array(leads, pa.binary()), pa.array(places, pa.int32())], ["normalised", "lead", "place"]
        )

    whole = fresh(docs, "_split")[0]
    rows = docs.withColumn(whole, split(F.col(f"`{text}`")))
    rows = rows.withColumns(
        {"normalised": F.col(f"{whole}.normalised"), lead: F.col(f"{whole}.lead"), place: F.col(f"{whole}.place")}
    ).drop(whole)
    key = F.col(f"`{id}`")
    spread = F.when(F.col(place) < 0, 0).otherwise(F.pmod(F.xxhash64(key), F.lit(SALTS)))
    if ended:
        totals = docs.sparkSession.createDataFrame(
            [(row["place"], row["keep"], row["n"]) for row in ended],
            f"{place} int, {known_keep} {docs.select(id).dtypes[0][1]}, {known_n} bigint",
        )
        rows = rows.join(F.broadcast(totals), place, "left")  # at most 1024 rows a level of the recursion
        strewn = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))
        spread = F.when(key.isNull() & F.col(known_keep).isNotNull(), strewn).otherwise(spread)
    else:
        rows = rows.withColumns({known_keep: F.lit(None).cast(docs.select(id).dtypes[0][1]), known_n: F.lit(None).cast("bigint")})
    rows = rows.withColumn(salt, spread)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = Window.partitionBy(lead, salt, "normalised")
    rows = rows.repartition(parts, lead, salt).withColumns(
        {
            "keep_id": F.coalesce(F.col(known_keep), F.max(key).over(group)),
            "group_size": F.coalesce(F.col(known_n), F.count(F.lit(1)).over(group)),
            rank: F.row_number().over(group.orderBy(key.desc_nulls_last())),
        }
    )
    kept = (F.col(rank) == 1) & key.eqNullSafe(F.col("keep_id"))
    return rows.withColumn("kept", kept).drop(lead, salt, place, known_keep, known_n, rank)


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of each group that stays, with the columns of ``docs``."""
    return exact_groups(docs, id, text).where("kept").select(*[F.col(f"`{name}`") for name in docs.columns])
