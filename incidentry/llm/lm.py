"""Scores of whole texts by a gated recurrent language model that is trained on all training texts.

Words are counted over the corpus and looked up by chunks. The most frequent words have ids of their own; every other word is known to the
recurrent model by its kind (its length, script and last sign), and the word within its kind by its smoothed count, so that the probabilities
of all words and one unseen word a kind sum to one. Training goes through the training texts once, in rounds that grow: in each, every
task starts from the shared weights and learns from its own texts, and the weights of all tasks are averaged by the ids they have seen.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from incidentry.llm import recurrent
from incidentry.operators.chunks import answered, by_place, chunk_number, cut, keys_of, packed, unpacked
from incidentry.llm.common import TO_LOWER, bytes_of, release, store, without
from incidentry.llm.recurrent import HEAD, KINDS

RESULTS = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
SMALL = 0.1
CHUNK_BYTES = 8 << 20
SIGNS = b".,;:!?"
LONGEST_HEAD = 64
LEARN_IDS, SCORE_IDS = 1 << 20, 1 << 22
ROUNDS = ((0, 1), (1, 3), (3, 8))  # shares of the texts in eighths
BLOCKS, SPREAD = 8, 64


def kind(word: bytes) -> int:
    """What the recurrent model knows of a word that is not among the frequent ones."""
    last = word[-1:] in SIGNS
    if not word.isascii():
        return int(last)
    bare = word.rstrip(SIGNS)
    if not bare.isalpha():
        return 2 if any(48 <= b < 58 for b in word) else 3
    n = len(bare)
    return 4 + 5 * last + (n > 4) + (n > 6) + (n > 8) + (n > 11)


def _numbered(rows: DataFrame, most: int) -> DataFrame:
    """The columns of ``rows`` but text and learn, each text as ``seq``, numbers of its words, and by chunk the words, their training counts and kinds."""
    added = "learn boolean, n_tokens bigint, seq binary, chunk bigint, keys array<binary>, n array<bigint>, kinds array<int>"
    schema = StructType([*rows.drop("text", "learn").schema, *StructType.fromDDL(added)])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = 0
        for batch in batches:
            texts = batch.column("text")
            learn = np.asarray(batch.column("learn").to_pylist(), bool)
            sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
            for first, end in cut(sizes, most):
                numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
                seqs = []
                for text in bytes_of(texts.slice(first, end - first)):
                    words = (text or b"").translate(TO_LOWER).split()
                    words.append(b"")  # the end
                    seqs.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                learnt = np.zeros(len(numbers), np.int64)
                for low in range(0, len(seqs), 1024):
                    some = [s for s, use in zip(seqs[low : low + 1024], learn[first + low : end]) if use]
                    if some:
                        learnt += np.bincount(np.concatenate(some), minlength=len(numbers))
                rest = [None] * (end - first - 1)
                columns = [
                    *batch.drop_columns(["text", "learn"]).slice(first, end - first).columns,
                    batch.column("learn").slice(first, end - first),
                    pa.array([len(s) for s in seqs], pa.int64()),
                    pa.array([packed(s) for s in seqs], pa.binary()),
                    pa.array([chunk_number(chunks)] * (end - first), pa.int64()),
                    pa.array([list(numbers), *rest], pa.list_(pa.binary())),
                    pa.array([learnt, *rest], pa.list_(pa.int64())),
                    pa.array([[kind(word) for word in numbers], *rest], pa.list_(pa.int32())),
                ]
                chunks += 1
                yield pa.RecordBatch.from_arrays(columns, schema.names)
                del numbers, seqs, columns
            release()

    return rows.mapInArrow(number, schema)


def _looked_up(documents: DataFrame, values: DataFrame, n: int, distinct: int, rare: np.ndarray) -> DataFrame:
    """``documents`` with n_known, base_score, rare_score (of words within their kinds), and ``ids`` of the recurrent model in place of ``seq``.

    ``rare`` holds the tokens and the different words of each kind.
    """
    schema = StructType([*documents.drop("seq", "chunk").schema, *StructType.fromDDL("n_known bigint, base_score double, rare_score double, ids binary")])
    every = n + SMALL * (distinct + 1)
    of_kind = rare[:, 0] + SMALL * (rare[:, 1] + 1)

    def look_up(rows: pa.Table, found: pa.Table) -> pa.Table:
        counts, codes = by_place(found, "count", np.int64), by_place(found, "code", np.int64)
        base = np.log10((counts + SMALL) / every)
        within = np.where(codes < HEAD, 0.0, np.log10((counts + SMALL) / of_kind[np.maximum(codes - HEAD, 0)]))
        told = []
        for data in rows.column("seq").to_pylist():
            seq = unpacked(data)[0]
            told.append((int((counts[seq] > 0).sum()), float(base[seq].sum()), float(within[seq].sum()), packed(codes[seq])))
        kept = rows.drop_columns(["seq", "chunk"])
        columns = [pa.array(values, t) for values, t in zip(zip(*told), (pa.int64(), pa.float64(), pa.float64(), pa.binary()))]
        return pa.Table.from_arrays([*kept.columns, *columns], schema.names)

    return answered(documents, values, look_up, schema)


def _buffers(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batches of together about ``most`` ids, with these."""
    for batch in batches:
        for first, end in cut(np.asarray(batch.column("n_tokens")), most):
            part = batch.slice(first, end - first)
            yield part, [unpacked(data)[0].astype(np.uint16) for data in part.column("ids").to_pylist()]


def _averaged(rows: DataFrame, weights: recurrent.Weights) -> recurrent.Weights:
    """One pass over ``rows`` (n_tokens, ids) by tasks that all start from ``weights``; the mean of what they end with, by the ids each has seen."""
    shared = rows.sparkSession.sparkContext.broadcast(recurrent.flat(weights))  # of one size whatever the corpus

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        learner = recurrent.Learner(recurrent.shaped(shared.value))
        for _, texts in _buffers(batches, LEARN_IDS):
            learner.learn(texts)
        if learner.ids:
            parts = np.array_split(recurrent.flat(learner.weights).astype(np.float64) * learner.ids, BLOCKS)
            salt = TaskContext.get().partitionId() % SPREAD
            yield pa.RecordBatch.from_pylist(
                [{"block": i, "salt": salt, "ids": learner.ids, "sums": part.tobytes()} for i, part in enumerate(parts)],
                schema=pa.schema([("block", pa.int32()), ("salt", pa.int32()), ("ids", pa.int64()), ("sums", pa.binary())]),
            )

    def added(table: pa.Table) -> pa.Table:
        total = np.zeros(len(table.column("sums")[0].as_py()) // 8)
        for data in table.column("sums"):
            total += np.frombuffer(data.as_py())
        first = {name: table.column(name)[0].as_py() for name in ("block", "salt")}
        return pa.Table.from_pylist([first | {"ids": sum(table.column("ids").to_pylist()), "sums": total.tobytes()}], schema=table.schema)

    form = "block int, salt int, ids bigint, sums binary"
    parts = rows.select("n_tokens", "ids").mapInArrow(learn, form).groupBy("block", "salt").applyInArrow(added, form)
    found = parts.groupBy("block").applyInArrow(added, form).collect()  # BLOCKS rows
    shared.destroy()
    if not found:
        return weights
    found.sort(key=lambda row: row["block"])
    return recurrent.shaped(np.concatenate([np.frombuffer(row["sums"]) / row["ids"] for row in found]))


def trained(rows: DataFrame, weights: recurrent.Weights) -> recurrent.Weights:
    """Weights after one pass over ``rows`` (n_tokens, ids) in rounds; a text's round follows from its ids."""
    share = F.pmod(F.xxhash64("ids"), F.lit(8))
    for low, high in ROUNDS:
        weights = _averaged(rows.where((share >= low) & (share < high)), weights)
    return weights


def score_texts(docs: DataFrame, learn: Column, text: str = "text", keep_text: bool = True, most: int = CHUNK_BYTES) -> DataFrame:
    """All rows of ``docs`` with n_tokens, n_known, train_tokens (bigint), base_score and score (double).

    Tokens are words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, and one end of each text; null counts as empty. The model learns from the
    rows where ``learn`` is true. ``base_score`` is the sum over tokens of log10((c + 0.1) / (N + 0.1 * (V + 1))), with a token's count c among
    the N training tokens, V of them different; ``n_known`` are tokens with a count. ``score`` is log10 of the text's probability by the
    recurrent model, from its first token to its end. Without training rows all that is learnt is left at equal shares. Columns with the
    name of a result are replaced.
    """
    kept = without(docs, *RESULTS, *([] if keep_text else [text]))
    names = kept.columns
    numbered = docs.select(
        *[F.col(f"`{name}`").alias(f"c{i}") for i, name in enumerate(names)],
        F.col(f"`{text}`").alias("text"),
        F.coalesce(learn, F.lit(False)).alias("learn"),
    )
    stored = store(_numbered(numbered, most), "numbered")
    same = Window.partitionBy("key")  # a key comes once per chunk
    counted = keys_of(stored, "n", "kinds").select(
        "chunk", "pos", "key", F.col("kinds").alias("kind"), F.sum("n").over(same).alias("count"), (F.row_number().over(same.orderBy("chunk")) == 1).alias("first")
    )
    counted = store(counted, "word-counts")
    known = counted.where("first and count > 0").select("key", "kind", "count")
    frequent = known.where((F.length("key") > 0) & (F.length("key") <= LONGEST_HEAD)).orderBy(F.desc("count"), "key").limit(HEAD - 1).collect()
    head = [(b"", 0), *[(bytes(row["key"]), i + 1) for i, row in enumerate(frequent)]]
    head = docs.sparkSession.createDataFrame(head, "key binary, id int")  # HEAD rows of at most LONGEST_HEAD bytes
    totals = known.join(F.broadcast(head), "key", "left").groupBy("id", F.when(F.col("id").isNull(), F.col("kind")).alias("kind"))
    totals = totals.agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("words")).collect()  # HEAD + KINDS rows
    rare, by_id = np.zeros((KINDS, 2), np.int64), np.zeros(HEAD + KINDS, np.int64)
    for row in totals:
        if row["id"] is None:
            rare[row["kind"]] = row["n"], row["words"]
        by_id[HEAD + row["kind"] if row["id"] is None else row["id"]] = row["n"]
    n, distinct = sum(row["n"] for row in totals), sum(row["words"] for row in totals)
    values = counted.join(F.broadcast(head), "key", "left")
    values = values.select("chunk", "pos", "count", F.coalesce(F.col("id"), F.col("kind") + HEAD).alias("code"))
    documents = stored.drop("keys", "n", "kinds")
    looked_up = store(_looked_up(documents, values, n, distinct, rare), "word-ids")
    weights = trained(looked_up.where("learn").select("n_tokens", "ids"), recurrent.started(by_id))
    scored = _scored(looked_up.drop("learn"), weights)
    results = {"train_tokens": F.lit(n).cast("bigint")}
    return scored.select(
        *[F.col(f"c{i}").alias(name) for i, name in enumerate(names)], *[results.get(name, F.col(name)).alias(name) for name in RESULTS]
    )


def _scored(rows: DataFrame, weights: recurrent.Weights) -> DataFrame:
    """``rows`` with the score in place of ids and rare_score."""
    shared = rows.sparkSession.sparkContext.broadcast(recurrent.flat(weights))
    schema = StructType([*rows.drop("ids", "rare_score").schema, *StructType.fromDDL("score double")])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt = recurrent.shaped(shared.value)
        for part, texts in _buffers(batches, SCORE_IDS):
            told = recurrent.score_all(learnt, texts) + np.asarray(part.column("rare_score"))
            yield pa.RecordBatch.from_arrays([*part.drop_columns(["ids", "rare_score"]).columns, pa.array(told)], schema.names)

    return rows.mapInArrow(score, schema)
