"""Near-duplicates by SimHash fingerprints, linked under a Hamming distance with pigeonring filtering.

A 64-bit fingerprint is cut into a ring of segments. With d differing bits at most and m segments, some segment starts a chain whose
first l segments differ in at most floor(l * d / m) bits for every l. Candidates are joined on the part of that condition that equality
can express: the first segment of the chain (its budget is 0), and one piece of the next segment that the budget leaves unchanged.
The whole chain is checked before the Hamming distance. Equal fingerprints are one node, so copies never form pairs. A key that
very many fingerprints share is not joined: its fingerprints meet through the values one flip away from them, grouped, which
gives the same components with rows in proportion to the fingerprints.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidentry.llm.common import TO_LOWER, bytes_of, fresh, store, without
from incidentry.llm.components import connected

BITS, SEED = 64, 42
BLOCK = 1 << 16
CROWDED = 64


def shingle_votes(words: list[bytes], size: int, seed: int) -> tuple[np.ndarray, int]:
    """How many shingle hashes have each bit set, lowest bit first, and the number of shingles."""
    grams = (b" ".join(g) for g in zip(*[islice(words, i, None) for i in range(size)])) if len(words) > size else iter([b" ".join(words)])
    votes, n = np.zeros(BITS, np.int64), 0
    digest = xxhash.xxh64_intdigest
    while block := [digest(g, seed) for g in islice(grams, BLOCK)]:
        raw = np.array(block, "<u8").view(np.uint8).reshape(len(block), 8)
        votes += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(block)
    return votes, n


def fingerprint(text: bytes, size: int = 3, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half of the shingle hashes; repeats count. Fewer words than ``size`` make one shingle, none make 0."""
    words = text.translate(TO_LOWER).split()
    if not words:
        return 0
    votes, n = shingle_votes(words, size, seed)
    return int.from_bytes(np.packbits(2 * votes > n, bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, name: str, text: str = "text", size: int = 3, seed: int = SEED) -> DataFrame:
    """Add the fingerprint as a signed 64-bit number. Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; null counts as empty."""

    @F.arrow_udf("bigint")
    def prints(values: pa.Array) -> pa.Array:
        found = np.array([fingerprint(data or b"", size, seed) for data in bytes_of(values)], np.uint64)
        return pa.array(found.view(np.int64))

    return docs.withColumn(name, prints(F.col(f"`{text}`")))


def _ring(distance: int) -> list[tuple[int, int]]:
    """(shift, width) of distance + 1 segments, so that a chain starts with an equal one."""
    m = distance + 1
    cuts = [BITS * i // m for i in range(m + 1)]
    return [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(m)]


def _bits(value: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << width) - 1))


def _keys(value: Column, distance: int) -> list[tuple[int, Column, list[tuple[int, int]]]]:
    """(number, key, free ranges): keys of which two prints within the distance share one; free ranges are the bits outside the key.

    Key (i, j): segment i and the j-th piece of segment i + 1, which has one piece more than the bits it may differ in.
    """
    ring = _ring(distance)
    m, made = len(ring), []
    for i, (shift, width) in enumerate(ring):
        after, span = ring[(i + 1) % m]
        pieces = 2 * distance // m + 1  # the chain's second budget, as its first is 0
        for j in range(pieces):
            low, high = span * j // pieces, span * (j + 1) // pieces
            key = F.struct(_bits(value, shift, width).alias("a"), _bits(value, after + low, high - low).alias("b"))
            fixed = [(shift, shift + width), (after + low, after + high)]
            made.append((i * pieces + j, key, fixed))
    return made


def _chain_holds(x: Column, y: Column, distance: int, start: int) -> Column:
    """Every prefix of the chain from segment ``start`` stays within its share of the distance."""
    ring = _ring(distance)
    m, differing, holds = len(ring), F.lit(0), F.lit(True)
    for step in range(m):
        shift, width = ring[(start + step) % m]
        differing = differing + F.bit_count(_bits(x.bitwiseXOR(y), shift, width))
        holds = holds & (differing <= (step + 1) * distance // m)
    return holds


def _masks(fixed: list[tuple[int, int]]) -> list[int]:
    """What a value is changed by to give itself and every value one flip away outside the fixed bits."""
    free = [b for b in range(BITS) if not any(low <= b < high for low, high in fixed)]
    return [0, *[1 << b if b < BITS - 1 else -(1 << b) for b in free]]


def links(prints: DataFrame, distance: int = 2, crowded: int = CROWDED) -> DataFrame:
    """Edges (u, v) whose components are those of the relation 'at most ``distance`` bits apart' over the distinct column ``fp``.

    Keys shared by more than ``crowded`` prints are handled without pairs, which needs a distance of 2 at most. They are compared by flips
    outside the key: two prints that share the key and differ in at most 2 bits have a common value at most one flip away from both.
    """
    if not 0 <= distance <= 2:
        raise ValueError("distances over 2 have no pair-free way for crowded keys")
    value = F.col("fp")
    if distance == 0:
        return prints.select(value.alias("u"), value.alias("v")).where(F.lit(False))
    keys = _keys(value, distance)
    rows = prints.select("fp", F.inline(F.array(*[F.struct(F.lit(n).alias("slot"), key.alias("key")) for n, key, _ in keys])))
    counts = rows.groupBy("slot", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = store(rows.join(counts.hint("merge"), ["slot", "key"]), "print-keys")
    few = rows.where(F.col("n") <= crowded)
    left, right = few.select("slot", "key", F.col("fp").alias("u")), few.select("slot", "key", F.col("fp").alias("v"))
    pieces = max(1, len(keys) // (distance + 1))
    chain = F.lit(False)
    for start in range(distance + 1):
        chain = chain | ((F.floor(F.col("slot") / pieces) == start) & _chain_holds(F.col("u"), F.col("v"), distance, start))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance
    pairs = left.join(right.hint("merge"), ["slot", "key"]).where(F.col("u") < F.col("v")).where(chain).where(near).select("u", "v")
    masks = F.lit([_masks(fixed) for _, _, fixed in keys]).cast("array<array<bigint>>")
    around = F.transform(masks[F.col("slot")], lambda mask: value.bitwiseXOR(mask))
    near_values = rows.where(F.col("n") > crowded).select("slot", "key", "fp", F.explode(around).alias("around"))
    hubs = near_values.groupBy("slot", "key", "around").agg(F.min("fp").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    spokes = near_values.join(hubs.hint("merge"), ["slot", "key", "around"])
    stars = spokes.where("fp != hub").select(F.col("fp").alias("u"), F.col("hub").alias("v"))
    return pairs.union(stars).distinct()


def _printed(docs: DataFrame, fp: str, id: str, text: str, size: int, keep_text: bool) -> DataFrame:
    rows = with_fingerprints(docs, fp, text, size)
    return store(rows if keep_text else rows.drop(text), "prints")


def _classes(rows: DataFrame, fp: str, id: str, distance: int, crowded: int) -> DataFrame:
    """(root, fp, first): every distinct fingerprint with the smallest fingerprint of its component, and the smallest id that has it."""
    nodes = store(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(F.col(f"`{id}`")).alias("first")), "nodes")
    roots = store(connected(links(nodes.select("fp"), distance, crowded)), "roots")
    found = nodes.join(roots.hint("merge"), nodes["fp"] == roots["node"], "left")
    return found.select(F.coalesce("root", "fp").alias("root"), "fp", "first")


def near_duplicates(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    size: int = 3,
    distance: int = 2,
    keep_text: bool = True,
    crowded: int = CROWDED,
) -> DataFrame:
    """All rows of ``docs`` with ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable over links.

    Texts without words have fingerprint 0 and are linked like any other. Rows that repeat an id are all returned; a component without
    any id has a null component_id. Columns with the name of a result column are replaced; ``keep_text=False`` leaves out the text.
    """
    docs = without(docs, "fingerprint", "component_id")
    fp, root, least = fresh(docs, "_fp", "_root", "_least")
    rows = _printed(docs, fp, id, text, size, keep_text)
    classes = store(_classes(rows, fp, id, distance, crowded), "classes")
    smallest = classes.groupBy("root").agg(F.min("first").alias(least))
    known = classes.join(smallest, "root").select(F.col("fp").alias(fp), least)
    found = rows.join(known, fp).withColumns({"fingerprint": hex16(F.col(fp)), "component_id": F.col(least)})
    return found.drop(fp, least)


def hex16(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def keep_one(
    docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 3, distance: int = 2, crowded: int = CROWDED
) -> DataFrame:
    """The row of each component with the smallest id, with the columns of ``docs``; one of the rows that repeat this id and fingerprint.

    Of a component without any id the rows with its smallest fingerprint are reduced to one.
    """
    fp, one = fresh(docs, "_fp", "_rank")
    rows = _printed(docs, fp, id, text, size, True)
    classes = _classes(rows, fp, id, distance, crowded)
    named = F.when(F.col("first").isNotNull(), F.struct("first", "fp"))
    kept = classes.groupBy("root").agg(F.coalesce(F.min(named), F.min(F.struct("first", "fp"))).alias("k"))
    kept = kept.select(F.col("k.first").alias("kept_id"), F.col("k.fp").alias("kept_fp"))
    chosen = rows.join(kept, F.col(f"`{id}`").eqNullSafe(kept["kept_id"]) & (F.col(fp) == kept["kept_fp"])).drop("kept_id", "kept_fp")
    repeats = Window.partitionBy(id, fp).orderBy(F.lit(1))
    chosen = chosen.withColumn(one, F.row_number().over(repeats)).where(F.col(one) == 1)
    return chosen.select(*[F.col(f"`{name}`") for name in docs.columns])
