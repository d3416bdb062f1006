"""Benchmark passages in documents by greedy string tiling.

Seeds are runs of ``least`` words. A bitmap of fixed size over the seeds of the benchmark lets documents without any of them pass by;
the seeds of the others are joined with the rarest of each item, as many as a pair with the wanted coverage cannot all lack, and pairs that
share too few seeds in all are left out, which loses none. In each remaining pair the longest common runs of unmarked words are found by running Karp-Rabin hashes and
marked, until no run of ``least`` words is left. The marked share of the benchmark item counts, in whatever order its parts stand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from incidentry.llm.common import fresh, store, without

LEAST, COVERAGE = 4, 0.5
FILTER_BITS = 1 << 24
ROUNDING, LIST_ITEMS = 1e-9, 64
DOC_KEY = ["key", "mark", "size"]
BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SIGNS = re.compile(r"[\W_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case."""
    return SIGNS.sub(" ", (text or "").lower()).split()


def seeds_of(words: list[str], least: int) -> list[str]:
    return list(map(" ".join, zip(*[words[i:] for i in range(least)])))


def _slots(seeds: list[str]) -> np.ndarray:
    """Two places in the bitmap for each seed."""
    hashes = np.array(list(map(xxhash.xxh64_intdigest, seeds)), np.uint64)
    return np.stack([hashes % FILTER_BITS, (hashes >> np.uint64(32)) % FILTER_BITS])


def seed_filter(benchmark: DataFrame, text: str, least: int) -> np.ndarray:
    """The bitmap, FILTER_BITS bits whatever the size of the benchmark; when it fills up it lets more documents through."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                if seeds := seeds_of(words_of(value), least):
                    found[_slots(seeds).ravel()] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(found), pa.int64())], ["place"])

    bitmap = np.zeros(FILTER_BITS, bool)
    for row in benchmark.select(text).mapInArrow(places, "place bigint").distinct().toLocalIterator():
        bitmap[row["place"]] = True
    return np.packbits(bitmap)


def _hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Running Karp-Rabin hashes of all windows of ``size`` word numbers."""
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(ids), BASE, np.uint64)]), dtype=np.uint64)
    undo = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(ids), BACK, np.uint64)]), dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * powers[:-1], dtype=np.uint64)])
    return (sums[size:] - sums[:-size]) * undo[: len(ids) - size + 1]


def _free(marked: np.ndarray, size: int) -> np.ndarray:
    """Windows without a marked word."""
    before = np.concatenate([[0], np.cumsum(marked)])
    return before[size:] == before[:-size]


def _common_runs(item: np.ndarray, doc: np.ndarray, used_item: np.ndarray, used_doc: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(length, item start, document start) of maximal common runs of at least ``size`` unmarked words."""
    if len(item) < size or len(doc) < size:
        return []
    held = _hashes(item, size)
    places: dict[int, list[int]] = {}
    for p in np.flatnonzero(_free(used_item, size)):
        places.setdefault(int(held[p]), []).append(int(p))
    if not places:
        return []
    seen = _hashes(doc, size)
    hits = np.flatnonzero(np.isin(seen, np.fromiter(places, np.uint64, len(places))) & _free(used_doc, size))
    found = []
    for t in hits.tolist():
        for p in places[int(seen[t])]:
            if not np.array_equal(item[p : p + size], doc[t : t + size]):
                continue
            if p and t and item[p - 1] == doc[t - 1] and not used_item[p - 1] and not used_doc[t - 1]:
                continue  # part of a longer run that starts earlier
            n = size
            while p + n < len(item) and t + n < len(doc) and item[p + n] == doc[t + n] and not used_item[p + n] and not used_doc[t + n]:
                n += 1
            found.append((n, p, t))
    return found


def tiles(item: list[str], doc: list[str], least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (length, item start, document start) of non-overlapping common runs, longest first."""
    numbers = {word: i for i, word in enumerate(dict.fromkeys(item))}
    a = np.array([numbers[word] for word in item], np.int64)
    b = np.array([numbers.get(word, -1 - i) for i, word in enumerate(doc)], np.int64)
    used_a, used_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    marked: list[tuple[int, int, int]] = []
    size = max(least, len(item) // 2)
    while True:
        runs = sorted(_common_runs(a, b, used_a, used_b, size), key=lambda run: (-run[0], run[1], run[2]))
        cut = 0
        for n, p, t in runs:
            if n < cut:
                break  # the rest of a longer run may be longer than this one
            if used_a[p : p + n].any() or used_b[t : t + n].any():
                cut = n  # what is left of it is found in another round
                continue
            used_a[p : p + n] = used_b[t : t + n] = True
            marked.append((n, p, t))
        if runs:
            continue
        if size == least:
            return marked
        size = max(least, size // 2)


def _marked_items(batches: Iterator[pa.RecordBatch], least: int, coverage: float) -> Iterator[pa.RecordBatch]:
    """A document's words and those of some items -> the items whose coverage is high enough."""
    names = ["key", "mark", "size", "item", "coverage", "tiles"]
    for batch in batches:
        rows: list[list] = [[] for _ in names]
        for key, mark, size, text, items in zip(*[batch.column(i).to_pylist() for i in range(5)]):
            doc = text.split(" ")
            seeds = set(seeds_of(doc, least))
            for one in items:
                wanted = one["item_words"].split(" ")
                if sum(seed in seeds for seed in seeds_of(wanted, least)) < len(wanted) * coverage / least - ROUNDING:
                    continue
                found = tiles(wanted, doc, least)
                share = sum(n for n, _, _ in found) / len(wanted)
                if share >= coverage - ROUNDING:
                    for values, value in zip(rows, (key, mark, size, one["item"], share, len(found))):
                        values.append(value)
        kinds = [*[batch.column(i).type for i in range(3)], batch.column(4).type.value_type.field("item").type]
        arrays = [pa.array(values, kind) for values, kind in zip(rows, kinds)]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(rows[4], pa.float64()), pa.array(rows[5], pa.int32())], names)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    least: int = LEAST,
    coverage: float = COVERAGE,
    id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(key, mark, size, item, coverage, tiles): document and item pairs whose tiles cover at least ``coverage`` of the item's words.

    ``mark`` and ``size`` are the hash and the length of the document's text and tell rows that repeat an id apart. Items of fewer than
    ``least`` words cannot be told from chance and match nothing, like null and empty texts. Items that repeat an id are each compared.
    """
    spark = docs.sparkSession
    bitmap = spark.sparkContext.broadcast(seed_filter(benchmark, item_text, least))
    key_kind, item_kind = docs.select(id).dtypes[0][1], benchmark.select(item).dtypes[0][1]

    @F.arrow_udf("struct<item:string, n:int, seeds:array<string>>")
    def cut(values: pa.Array) -> pa.Array:
        words = [words_of(value) for value in values.to_pylist()]
        columns = [pa.array([" ".join(w) for w in words], pa.string()), pa.array(list(map(len, words)), pa.int32())]
        seeds = pa.array([seeds_of(w, least) for w in words], pa.list_(pa.string()))
        return pa.StructArray.from_arrays([*columns, seeds], ["item", "n", "seeds"])

    items = benchmark.select(F.col(f"`{item}`").alias("item"), cut(F.col(f"`{item_text}`")).alias("c"))
    items = store(items.select("item", F.col("c.item").alias("words"), F.col("c.n").alias("n"), F.col("c.seeds").alias("seeds")).where(f"n >= {least}"), "items")

    @F.arrow_udf("struct<words:string, seeds:array<string>>")
    def probe(values: pa.Array) -> pa.Array:
        bits, texts, kept = bitmap.value, [], []
        for value in values.to_pylist():
            words = words_of(value)
            seeds = seeds_of(words, least)
            if seeds:
                slots = _slots(seeds)
                hit = ((bits[slots >> np.uint64(3)] >> (np.uint64(7) - (slots & np.uint64(7))).astype(np.uint8)) & 1).all(axis=0)
                seeds = list({seeds[i] for i in np.flatnonzero(hit)})
            texts.append(" ".join(words) if seeds else None)
            kept.append(seeds)
        columns = [pa.array(texts, pa.string()), pa.array(kept, pa.list_(pa.string()))]
        return pa.StructArray.from_arrays(columns, ["words", "seeds"])

    keyed = docs.select(
        F.col(f"`{id}`").alias("key"), text_mark(F.col(f"`{text}`")).alias("mark"), text_size(F.col(f"`{text}`")).alias("size"), probe(F.col(f"`{text}`")).alias("c")
    )
    touched = keyed.select("key", "mark", "size", F.col("c.words").alias("words"), F.col("c.seeds").alias("seeds")).where("words is not null").dropDuplicates(["key", "mark", "size"])
    touched = store(touched, "touched")
    pairs = candidates(touched, items, least, coverage)
    known = items.select(F.xxhash64("item", "words").alias("row"), "item", F.col("words").alias("item_words")).distinct()
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"t.{c}")) for c in DOC_KEY]
    # a document that may hold many items meets them some at a time
    place = F.row_number().over(Window.partitionBy(*DOC_KEY).orderBy("row"))
    parts = pairs.withColumn("part", F.floor((place - 1) / F.lit(LIST_ITEMS)).cast("bigint"))
    listed = parts.join(known, "row").groupBy(*DOC_KEY, "part").agg(F.collect_list(F.struct("item", "item_words")).alias("items"))
    texts = listed.alias("p").join(touched.alias("t"), same[0] & same[1] & same[2])
    texts = texts.select("t.key", "t.mark", "t.size", "t.words", "p.items")
    schema = f"key {key_kind}, mark bigint, size bigint, item {item_kind}, coverage double, tiles int"
    return store(texts.mapInArrow(lambda batches: _marked_items(batches, least, coverage), schema), "contaminated")


def wanted_seeds(n: Column, coverage: float, least: int) -> Column:
    """How many of an item's seeds its tiles hold at least if they cover enough of it: a run of L words holds at least L / least seeds."""
    return F.ceil(n * F.lit(coverage / least) - ROUNDING)


def candidates(touched: DataFrame, items: DataFrame, least: int, coverage: float) -> DataFrame:
    """(key, mark, size, row): documents and items that may share enough seeds.

    A pair that shares as many of the item's seeds as wanted misses no more than the rest, so it shares one of any more than that. Documents
    are joined with so many of an item's seeds only, those that the fewest documents hold; a phrase that all items and documents share
    joins none of them.
    """
    doc_seeds = touched.select(*DOC_KEY, F.explode("seeds").alias("seed"))
    held = doc_seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("held"))
    seeds = items.select(F.xxhash64("item", "words").alias("row"), "n", F.explode("seeds").alias("seed"))
    seeds = seeds.groupBy("row", "n", "seed").agg(F.count(F.lit(1)).alias("times")).join(held, "seed", "left")
    rarest = Window.partitionBy("row", "n").orderBy(F.coalesce("held", F.lit(0)), "seed")
    before = F.coalesce(F.sum("times").over(rarest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = F.sum("times").over(Window.partitionBy("row", "n"))
    chosen = seeds.withColumns({"before": before, "every": every}).where(F.col("before") <= F.col("every") - wanted_seeds(F.col("n"), coverage, least))
    return doc_seeds.join(chosen.where("held is not null").select("row", "seed"), "seed").select(*DOC_KEY, "row").distinct()


def text_mark(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(-1)).cast("bigint")


def _joined(docs: DataFrame, found: DataFrame, id: str, text: str, how: str) -> DataFrame:
    same = docs[id].eqNullSafe(found["key"]) & (text_mark(docs[text]) == found["mark"]) & (text_size(docs[text]) == found["size"])
    return docs.join(found, same, how)


def judged(
    docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """All rows of ``docs`` with ``contaminated``, ``coverage`` and ``item_id`` of the best covered item, ``tiles`` of it, and ``items``.

    For documents without an item that is covered as wanted these are false, 0, null, 0 and 0. Ties go to the smaller item. Columns with the name
    of a result column are replaced.
    """
    docs = without(docs, "contaminated", "coverage", "item_id", "tiles", "items")
    found = contaminated(docs, benchmark, least, coverage, id, text)
    best = found.groupBy("key", "mark", "size").agg(
        F.min(F.struct((-F.col("coverage")).alias("c"), "item", "tiles")).alias("best"), F.countDistinct("item").alias("n")
    )
    best_name, n_name = fresh(docs, "_best", "_n")
    best = best.withColumnRenamed("best", best_name).withColumnRenamed("n", n_name)
    rows = _joined(docs, best, id, text, "left")
    return rows.select(
        *[docs[f"`{name}`"] for name in docs.columns],
        F.col(n_name).isNotNull().alias("contaminated"),
        F.coalesce(-F.col(f"{best_name}.c"), F.lit(0.0)).alias("coverage"),
        F.col(f"{best_name}.item").alias("item_id"),
        F.coalesce(F.col(f"{best_name}.tiles"), F.lit(0)).alias("tiles"),
        F.coalesce(F.col(n_name), F.lit(0)).alias("items"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    found = contaminated(docs, benchmark, least, coverage, id, text).select("key", "mark", "size").distinct()
    return _joined(docs, found, id, text, "left_anti")
