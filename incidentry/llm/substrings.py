"""Repeated passages by super-k-mer partitioning.

A window is a run of ``size`` words of one document. Consecutive windows that share their minimiser, the smallest hash of a run of
MINIMISER words in them, travel as one packed string to the bucket of that minimiser; equal windows always meet in one bucket. There the
windows are sorted by hash, neighbours with equal hashes are compared byte for byte, and every window learns the smallest id of a document that
has it. Within a batch equal packed strings travel once with a list of their places. Minimisers that a planning sample finds in very
many windows are split by a second minimiser of another order, and what is still crowded by the window itself. Runs of
repeated words come back for groups of places, which are dealt out before they are told apart by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentry.llm.common import bytes_of, fresh, store, without

WINDOW, MINIMISER = 50, 4
BASE = 0x9E3779B97F4A7C15 | 1
BACK = pow(BASE, -1, 1 << 64)
SAMPLE_SHARE, CROWDED_WINDOWS, MOST_CROWDED = 16, 4000, 1 << 16
CHUNK_BYTES, GROUP_PLACES = 2 << 20, 64
SPACE = 32


PLACE = np.dtype([("doc", "<i8"), ("mark", "<i8"), ("start", "<i4")])  # mark of the text; number of the first word


class Powers:
    """Powers of the base and of its inverse, for hashes of any part of a buffer."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            room = max(n, 2 * len(self.up))
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(room - 1, BASE, np.uint64)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(room - 1, BACK, np.uint64)], dtype=np.uint64)
        return self.up[:n], self.down[:n]


POWERS = Powers()


def _sums(buffer: np.ndarray) -> np.ndarray:
    up, _ = POWERS.upto(len(buffer) + 1)
    out = np.zeros(len(buffer) + 1, np.uint64)
    np.multiply(up[:-1], buffer, out=out[1:])
    return np.cumsum(out, out=out)


def _hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from start to end, alike wherever they stand."""
    return (sums[end] - sums[start]) * POWERS.upto(len(sums))[1][start]


def _mixed(values: np.ndarray, salt: int) -> np.ndarray:
    x = values ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every run of ``width`` values."""
    done, now = 1, values
    while 2 * done <= width:
        now = np.minimum(now[:-done], now[done:])
        done *= 2
    return np.minimum(now[: len(now) - (width - done)], now[width - done :]) if done < width else now


class Words:
    """The words of a batch of texts in one buffer: where each starts and ends, and whose it is."""

    def __init__(self, texts: list[bytes]) -> None:
        joined = [b" ".join(text.split()) for text in texts]
        self.data = b" ".join(part for part in joined if part) + b" "
        self.buffer = np.frombuffer(self.data, np.uint8)
        self.counts = np.array([part.count(b" ") + 1 if part else 0 for part in joined], np.int64)
        self.ends = np.flatnonzero(self.buffer == SPACE) if self.counts.any() else np.zeros(0, np.int64)
        self.starts = np.r_[0, self.ends[:-1] + 1] if len(self.ends) else self.ends
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self.first = np.cumsum(self.counts) - self.counts


def window_keys(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(first words of all windows, two minimisers and the hash of each window); None without windows."""
    n = len(words.starts)
    if n < size:
        return None
    sums = _sums(words.buffer)
    m = min(MINIMISER, size)
    grams = _hash(sums, words.starts[: n - m + 1], words.ends[m - 1 :])
    whole = _hash(sums, words.starts[: n - size + 1], words.ends[size - 1 :])
    inside = np.flatnonzero(words.doc[: n - size + 1] == words.doc[size - 1 :])
    if not len(inside):
        return None
    keys = [_lowest(_mixed(grams, salt), size - m + 1)[inside] for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    return inside, keys[0], keys[1], _mixed(whole[inside], 0x2545F4914F6CDD1D)


def bucket_keys(first: np.ndarray, second: np.ndarray, whole: np.ndarray, crowded: np.ndarray, crowded_pairs: np.ndarray) -> np.ndarray:
    """A window's bucket: its minimiser; of a crowded one both minimisers; of a crowded pair the window's own hash."""
    if not len(crowded):
        return first
    key = first.copy()
    hot = np.isin(first, crowded)
    pair = _mixed(first[hot] * np.uint64(3) + second[hot], 0x1234567)
    key[hot] = np.where(np.isin(pair, crowded_pairs), _mixed(whole[hot], 0x7654321), pair) if len(crowded_pairs) else pair
    return key


def _crowded(docs: DataFrame, text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimisers, and pairs of them, with a large share of all windows. Found on a sixteenth of the rows; they decide on distribution only."""

    def counts(level: int, hot: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = window_keys(Words([t or b"" for t in bytes_of(batch.column(0))]), size)
                keys = np.zeros(0, np.uint64)
                if found is not None:
                    _, first, second, _ = found
                    keys = first
                    if level:
                        at = np.isin(first, hot)
                        keys = _mixed(first[at] * np.uint64(3) + second[at], 0x1234567)
                values, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], ["key", "n"])

        return run

    # a third of all rows may be copies of one text, so the sample is drawn by place and not by text
    sample = docs.select(text).where(F.pmod(F.monotonically_increasing_id(), F.lit(SAMPLE_SHARE)) == 0)
    found: list[np.ndarray] = []
    for level in range(2):
        hot = found[0] if level else np.zeros(0, np.uint64)
        if level and not len(hot):
            return hot, hot
        counted = sample.mapInArrow(counts(level, hot), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
        rows = counted.where(F.col("n") > CROWDED_WINDOWS).orderBy(F.desc("n")).limit(MOST_CROWDED).collect()
        found.append(np.sort(np.array([row["key"] for row in rows], np.int64).view(np.uint64)))
    return found[0], found[1]


def _pack(batches: Iterator[pa.RecordBatch], size: int, crowded: np.ndarray, crowded_pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Documents (key, mark, text) -> super-k-mers: bucket, packed words, and the documents, marks and word numbers where they stand."""
    for batch in batches:
        texts = [t or b"" for t in bytes_of(batch.column(2))]
        keys, marks = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        at = 0
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and (end == at or held + len(texts[end]) <= CHUNK_BYTES):
                held += len(texts[end])
                end += 1
            yield _packed(Words(texts[at:end]), keys[at:end], marks[at:end], size, crowded, crowded_pairs)
            at = end


def _packed(
    words: Words, keys: np.ndarray, marks: np.ndarray, size: int, crowded: np.ndarray, crowded_pairs: np.ndarray
) -> pa.RecordBatch:
    places: dict[tuple[int, bytes], list[bytes]] = {}
    if (found := window_keys(words, size)) is not None:
        at, first, second, whole = found
        bucket = bucket_keys(first, second, whole, crowded, crowded_pairs)
        new = np.r_[True, (bucket[1:] != bucket[:-1]) | (at[1:] != at[:-1] + 1) | (words.doc[at[1:]] != words.doc[at[:-1]])]
        begin = np.flatnonzero(new)
        last = at[np.r_[begin[1:], len(at)] - 1]
        begin_word = at[begin]
        doc = words.doc[begin_word]
        where = np.empty(len(begin), PLACE)
        where["doc"], where["mark"], where["start"] = keys[doc], marks[doc], begin_word - words.first[doc]
        data, raw, step = words.data, where.tobytes(), PLACE.itemsize
        lows, highs = words.starts[begin_word].tolist(), words.ends[last + size - 1].tolist()
        for i, (key, low, high) in enumerate(zip(bucket[begin].tolist(), lows, highs)):
            places.setdefault((key, data[low:high]), []).append(raw[i * step : (i + 1) * step])
    buckets = np.fromiter((key for key, _ in places), np.uint64, len(places)).view(np.int64)
    texts, where = [text for _, text in places], [b"".join(p) for p in places.values()]
    return pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(texts, pa.binary()), pa.array(where, pa.binary())], ["bucket", "packed", "places"])


def _earliest(packed: list[bytes], least: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of some packed strings: the string, the place in it, and the smallest document of all equal windows."""
    data = b" ".join(packed) + b" "
    buffer = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(buffer == SPACE)
    starts = np.r_[0, ends[:-1] + 1]
    counts = np.array([text.count(b" ") + 1 for text in packed], np.int64)
    owner = np.repeat(np.arange(len(packed)), counts)
    first = np.cumsum(counts) - counts
    n = len(starts)
    at = np.flatnonzero(owner[: n - size + 1] == owner[size - 1 :])
    low, high = starts[at], ends[at + size - 1]
    hashes = _hash(_sums(buffer), low, high)
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    group = np.r_[0, np.cumsum(ranked[1:] != ranked[:-1])]
    smallest = least[owner[at]]
    sizes = np.bincount(group)
    best = smallest.copy()
    if (sizes > 1).any():
        edge = np.r_[0, np.cumsum(sizes)]
        for g in np.flatnonzero(sizes > 1):
            members = order[edge[g] : edge[g + 1]]
            texts = [data[low[i] : high[i]] for i in members.tolist()]
            if texts.count(texts[0]) == len(texts):
                best[members] = smallest[members].min()
            else:  # equal hashes of different windows
                seen: dict[bytes, int] = {}
                for i, text in zip(members.tolist(), texts):
                    seen[text] = min(seen.get(text, smallest[i]), smallest[i])
                for i, text in zip(members.tolist(), texts):
                    best[i] = seen[text]
    return owner[at], at - first[owner[at]], best


def _repeated(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Super-k-mers in the order of their buckets -> runs of their words that windows of earlier documents cover, and the places they hold for."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = now if held is None else pa.concat_tables([held, now])
        buckets = now.column(0).to_numpy()
        ends = np.flatnonzero(buckets[1:] != buckets[:-1]) + 1  # of whole buckets; the last one may go on in the next batch
        sizes = np.r_[0, np.cumsum(pc.binary_length(now.column(1)).to_numpy())]
        at = 0
        for end in ends.tolist():
            if sizes[end] - sizes[at] >= CHUNK_BYTES or (end == ends[-1] and sizes[-1] - sizes[at] >= CHUNK_BYTES):
                yield _spans(now.slice(at, end - at), size)
                at = end
        held = now.slice(at)
    if held is not None:
        yield _spans(held, size)


def _spans(table: pa.Table, size: int) -> pa.RecordBatch:
    """Rows (places, lows, highs): word runs counted from the start of a super-k-mer, and at most GROUP_PLACES of the places where it stands."""
    packed = table.column(1).to_pylist()
    out: tuple[list, list, list] = ([], [], [])
    if packed:
        counts = pc.binary_length(table.column(2)).to_numpy() // PLACE.itemsize
        places = np.frombuffer(b"".join(table.column(2).to_pylist()), PLACE)
        begin = np.cumsum(counts) - counts
        least, most = (f.reduceat(places["doc"], begin) for f in (np.minimum, np.maximum))
        text, place, best = _earliest(packed, least, size)
        edges = np.searchsorted(text, np.arange(len(packed) + 1))
        for i in np.unique(text[best < most[text]]).tolist():
            mine, where = best[edges[i] : edges[i + 1]], place[edges[i] : edges[i + 1]]
            own, values = places[begin[i] : begin[i] + counts[i]], np.unique(mine)
            earlier = np.searchsorted(values, own["doc"])  # how many of the values lie before the document
            for n in np.unique(earlier[earlier > 0]).tolist():
                later = where[mine <= values[n - 1]]
                breaks = np.flatnonzero(np.diff(later) > 1)
                lows, highs = later[np.r_[0, breaks + 1]], later[np.r_[breaks, len(later) - 1]] + size
                alike = own[earlier == n]
                for at in range(0, len(alike), GROUP_PLACES):
                    for values_of, value in zip(out, (alike[at : at + GROUP_PLACES].tobytes(), lows, highs)):
                        values_of.append(value)
    kinds = (pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(out, kinds)], ["places", "lows", "highs"])


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_spans`` -> (doc, mark, low, high), counted from the start of the document."""
    for batch in batches:
        parts: list[tuple[np.ndarray, ...]] = []
        for raw, lows, highs in zip(*(batch.column(i).to_pylist() for i in range(3))):
            own = np.repeat(np.frombuffer(raw, PLACE), len(lows))
            times = len(own) // len(lows)
            parts.append((own["doc"], own["mark"], own["start"] + np.tile(lows, times), own["start"] + np.tile(highs, times)))
        columns = [np.concatenate([part[i] for part in parts]) if parts else np.zeros(0) for i in range(4)]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        arrays = [pa.array(column.astype(kind.to_pandas_dtype())) for column, kind in zip(columns, kinds)]
        yield pa.RecordBatch.from_arrays(arrays, ["doc", "mark", "low", "high"])


def repeated_spans(docs: DataFrame, size: int = WINDOW, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, mark, low, high): words low to high - 1 of a document that lie in windows which also start in a document with a smaller id.

    Rows with a null id or text have no windows. Rows that repeat an id are one document for the comparison: none of them is earlier
    than the other. ``mark`` is the hash of the row's text, by which such rows are told apart. Spans of one document may overlap or touch.
    """
    given = docs.where(F.col(f"`{id}`").isNotNull()).select(
        F.col(f"`{id}`").cast("bigint").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("mark"), F.col(f"`{text}`").alias("text")
    )
    crowded, crowded_pairs = _crowded(docs, text, size)
    schema = "bucket bigint, packed binary, places binary"
    packed = given.mapInArrow(lambda batches: _pack(batches, size, crowded, crowded_pairs), schema)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = packed.repartition(parts, "bucket").sortWithinPartitions("bucket")
    found = store(grouped.mapInArrow(lambda batches: _repeated(batches, size), "places binary, lows array<int>, highs array<int>"), "spans")
    # a bucket of a common passage has many places in few rows: these are dealt out before they are told apart by document
    return found.repartition(parts).mapInArrow(_by_document, "doc bigint, mark bigint, low int, high int")


def without_repeats(docs: DataFrame, size: int = WINDOW, id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows of ``docs`` with ``kept_text`` (the words left, joined by one space), ``n_words``, ``n_removed`` and ``spans``.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; a null text has none. ``spans`` lists the removed (low, high) in order, merged. Rows with a
    null id keep all their words. Columns with the name of a result column are replaced.
    """
    docs = without(docs, "kept_text", "n_words", "n_removed", "spans")
    spans = repeated_spans(docs, size, id, text)
    key, mark, lows, highs = fresh(docs, "_key", "_mark", "_lows", "_highs")
    lists = spans.distinct().groupBy("doc", "mark").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("all"))
    lists = lists.select(F.col("doc").alias(key), F.col("mark").alias(mark), F.col("all.low").alias(lows), F.col("all.high").alias(highs))
    same = (F.col(f"`{id}`").cast("bigint") == F.col(key)) & (F.xxhash64(F.col(f"`{text}`")) == F.col(mark))
    rows = docs.join(lists, same, "left")

    @F.arrow_udf("struct<kept_text:string, n_words:bigint, n_removed:bigint, spans:array<struct<low:int,high:int>>>")
    def cut(texts: pa.Array, lows: pa.Array, highs: pa.Array) -> pa.Array:
        kept, n, gone, merged = [], [], [], []
        for data, low, high in zip(bytes_of(texts), lows.to_pylist(), highs.to_pylist()):
            words = (data or b"").split()
            runs: list[list[int]] = []
            for a, b in zip(low or (), high or ()):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            runs = [[a, min(b, len(words))] for a, b in runs if a < len(words)]
            n.append(len(words))
            for a, b in reversed(runs):
                del words[a:b]
            gone.append(n[-1] - len(words))
            kept.append(b" ".join(words).decode())
            merged.append([{"low": a, "high": b} for a, b in runs])
        pair = pa.struct([("low", pa.int32()), ("high", pa.int32())])
        arrays = [pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(merged, pa.list_(pair))]
        return pa.StructArray.from_arrays(arrays, ["kept_text", "n_words", "n_removed", "spans"])

    result = fresh(docs, "_cut")[0]
    rows = rows.withColumn(result, cut(F.col(f"`{text}`"), F.col(lows), F.col(highs)))
    columns = [F.col(f"`{name}`") for name in docs.columns]
    return rows.select(*columns, *[F.col(f"{result}.{name}").alias(name) for name in ("kept_text", "n_words", "n_removed", "spans")])
