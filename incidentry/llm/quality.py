"""Quality scores by nearest-neighbour voting over latent-semantic vectors.

Terms are words, word shapes (letters, digits and signs, runs shortened) and marks for length, repetition and repeated lines. A bounded,
stated number of labelled rows is reduced to latent dimensions by a singular value decomposition; their vectors and labels are what is
broadcast. The decomposition is found by subspace iteration over the sparse rows. Every document is projected and compared with all of them in blocks of exact cosine products; the nearest ones vote,
weighted by similarity. Every document is scored as a whole.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentry.llm.common import TO_LOWER, bytes_of, without

SPACES = b" \t\n\r\x0b\x0c"
WORD_SLOTS, SHAPE_SLOTS, MARK_SLOTS = 1 << 14, 1 << 10, 1 << 8
SLOTS = WORD_SLOTS + SHAPE_SLOTS + MARK_SLOTS
WEIGHTS = (0.5, 1.0, 1.0)
RANK, NEIGHBOURS, SHARPNESS = 64, 15, 4.0
FIT_ROWS, SCORE_BLOCK = 4096, 1024
SPARE, ITERATIONS = 16, 6

Terms = tuple[np.ndarray, np.ndarray]  # slots and weights


def _shapes() -> bytes:
    kinds = bytearray(range(256))
    for b in range(256):
        if chr(b).isdigit() and b < 128:
            kinds[b] = ord("0")
        elif b >= 128 or chr(b).isalpha():
            kinds[b] = ord("a")
    return bytes(kinds)


SHAPES = _shapes()
RUN = re.compile(rb"([^ ])\1+")


def _scaled(counts: Counter, first: int, slots: int, weight: float, damp: bool) -> tuple[list[int], np.ndarray]:
    places = [first + zlib.crc32(term) % slots for term in counts]
    values = np.fromiter(counts.values(), np.float32, len(counts))
    if damp:
        values = 1 + np.log(values)
    norm = float(np.sqrt((values * values).sum()))
    return places, values * np.float32(weight / norm) if norm else values


def terms(text: bytes) -> Terms:
    """Slots and weights of a text's terms; each of the three kinds has a length of its own. Empty texts have marks only."""
    words = text.translate(TO_LOWER).split()
    shapes = Counter(RUN.sub(rb"\1", b" ".join(text.translate(SHAPES).split())).split(b" ")) if words else Counter()
    lines = [line for line in text.split(b"\n") if line.strip(SPACES)]
    n, kinds = len(words), Counter(words)
    again = sum(map(bytes.__eq__, words, words[1:])) if n > 1 else 0
    marks = Counter(
        {
            b"size %d" % n.bit_length(): 1,
            b"variety %d" % (16 * len(kinds) // max(n, 1)): 1,
            b"variety by size %d %d" % (8 * len(kinds) // max(n, 1), n.bit_length()): 1,
            b"again %d" % (16 * again // max(n, 1)): 1,
            b"lines %d" % (8 * len(set(lines)) // max(len(lines), 1)): 1,
            b"word bytes %d" % (2 * len(text) // max(n, 1) // 2): 1,
        }
    )
    parts = (
        _scaled(kinds, 0, WORD_SLOTS, WEIGHTS[0], True),
        _scaled(shapes, WORD_SLOTS, SHAPE_SLOTS, WEIGHTS[1], False),
        _scaled(marks, WORD_SLOTS + SHAPE_SLOTS, MARK_SLOTS, WEIGHTS[2], False),
    )
    return np.array([p for places, _ in parts for p in places], np.int64), np.concatenate([values for _, values in parts])


@dataclass
class Model:
    basis: np.ndarray  # slots x rank, with the inverse document frequencies
    vectors: np.ndarray  # labelled rows x rank, of unit length
    labels: np.ndarray
    prior: float

    def project(self, rows: Iterable[Terms]) -> np.ndarray:
        found = [weights @ self.basis[places] for places, weights in rows]
        out = np.array(found, np.float32).reshape(len(found), self.basis.shape[1])
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Share of label 1 among the nearest labelled rows, weighted by similarity; the share of all where nothing is similar."""
        found = np.full(len(texts), self.prior)
        for start in range(0, len(texts), SCORE_BLOCK):
            block = self.project(map(terms, texts[start : start + SCORE_BLOCK]))
            cosine = block @ self.vectors.T
            k = min(NEIGHBOURS, cosine.shape[1])
            if not k:
                continue
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, 1).astype(np.float64), 0) ** SHARPNESS
            total = weight.sum(axis=1)
            votes = (weight * self.labels[near]).sum(axis=1)
            found[start : start + len(block)] = np.where(total > 0, votes / np.where(total > 0, total, 1), self.prior)
        return np.clip(found, 0.0, 1.0)


def _subspace(rows: list[Terms], rank: int) -> np.ndarray:
    """The leading right singular vectors, as columns, by subspace iteration with a few spare directions."""
    width = min(rank + SPARE, len(rows))
    found = np.random.default_rng(0).standard_normal((SLOTS, width))
    for _ in range(ITERATIONS):
        left = np.linalg.qr(np.array([weights @ found[places] for places, weights in rows]))[0]
        found = np.zeros((SLOTS, left.shape[1]))
        for i, (places, weights) in enumerate(rows):
            found[places] += np.outer(weights, left[i])
    right, sizes, _ = np.linalg.svd(found, full_matrices=False)
    return right[:, : min(rank, int((sizes > 1e-6).sum()))]


def merged(places: np.ndarray, weights: np.ndarray) -> Terms:
    """Each slot once, with the sum of its weights."""
    unique, where = np.unique(places, return_inverse=True)
    return unique, np.bincount(where, weights, len(unique))


def fit_terms(rows: list[Terms], labels: list[int], rank: int = RANK) -> Model:
    """Inverse document frequencies, the latent basis and the labelled vectors."""
    seen = np.zeros(SLOTS)
    rows = [merged(places, weights) for places, weights in rows]
    for places, _ in rows:
        seen[places] += 1
    idf = np.log((1 + len(rows)) / (1 + seen)) + 1
    right = _subspace([(places, weights * idf[places]) for places, weights in rows], rank) if rows else np.zeros((SLOTS, 0))
    basis = (idf[:, None] * right).astype(np.float32)
    model = Model(basis, np.zeros((0, basis.shape[1]), np.float32), np.array(labels, np.float64), float(np.mean(labels)) if labels else 0.5)
    model.vectors = model.project(rows)
    return model


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", most: int = FIT_ROWS) -> Model:
    """A model from at most ``most`` labelled rows, chosen by the hash of their key; rows with a null label are left out.

    The choice is made among the labels, so that the documents are read past a broadcast of ``most`` keys and never exchanged. Without any
    labelled row every score is 0.5.
    """
    known = labels.where(F.col(f"`{label}`").isNotNull()).select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("key"), "key").limit(most)

    @F.arrow_udf("struct<places:binary, weights:binary>")
    def found(values: pa.Array) -> pa.Array:
        rows = [merged(*terms(data or b"")) for data in bytes_of(values)]
        columns = [pa.array([r[0].astype("<i4").tobytes() for r in rows]), pa.array([r[1].astype("<f4").tobytes() for r in rows])]
        return pa.StructArray.from_arrays([c.cast(pa.binary()) for c in columns], ["places", "weights"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in batch.to_pylist()]
        rows.sort(key=lambda row: (row["key"], row["label"], row["terms"]["places"]))
        vectors = [(np.frombuffer(row["terms"]["places"], "<i4"), np.frombuffer(row["terms"]["weights"], "<f4")) for row in rows]
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(fit_terms(vectors, [row["label"] for row in rows]))]})

    texts = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    rows = texts.join(F.broadcast(chosen), "key").select(found("text").alias("terms"), "label", "key").limit(most)
    model = rows.coalesce(1).mapInArrow(fitted, "model binary").first()  # at most ``most`` rows of at most SLOTS terms meet in one task
    return pickle.loads(model["model"]) if model else fit_terms([], [])


def score(model: Model, text: Column, spark) -> Column:
    """The score of a text, null counting as empty, as a double between 0 and 1."""
    shared = spark.sparkContext.broadcast(model)  # at most FIT_ROWS vectors and SLOTS x RANK weights

    @F.arrow_udf("double")
    def scored(values: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores([data or b"" for data in bytes_of(values)]))

    return scored(text)


def with_scores(docs: DataFrame, model: Model, name: str = "score", text: str = "text") -> DataFrame:
    """All rows of ``docs`` with the score; an input column of that name is replaced."""
    docs = without(docs, name)
    return docs.withColumn(name, score(model, F.col(f"`{text}`"), docs.sparkSession))


def held_out(key: Column) -> Column:
    """Rows that no model is fitted on: crc32 of the key as text, modulo 5, is 0."""
    return F.crc32(F.encode(key.cast("string"), "UTF-8")) % 5 == 0
