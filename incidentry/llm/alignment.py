"""Alignment of two tokenizers' tokens over the same texts, and counts of linked token pairs over all documents.

Both tokenizers encode a text, their tokens' bytes must give the text again, and byte offsets where tokens of both end cut them into groups. Most
groups hold one token of each side, so the ends of both run in step for long stretches: at the current shift between the indices, stretches
of ends are compared that double in length while they are equal and halve where they are not; what follows is an irregular group, resolved
token by token, which sets a new shift. A pair of tokens that overlap is a link. How many documents hold a pair linked is counted over the
corpus and comes back to the documents by chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from incidentry.operators.chunks import CHUNK_BYTES, answered, by_place, chunk_number, cut, keys_of, packed, unpacked
from incidentry.llm.common import bytes_of, store, without
from incidentry.llm.token_files import Encoder

RESULTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
BATCH_BYTES, WORDS, REMEMBERED_BYTES, ENTRY_BYTES = 1 << 20, 256, 64 << 20, 150
MARK = "▁"
A_ON, B_ON, BOTH = 1, 2, 3  # what a link is followed by: the next token of A, of B, or of both


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes as: printable ones stand for themselves, the rest follow from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel(Encoder):
    """Ids by a byte-level vocabulary; strings of special tokens in a text are plain text."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.added = []
        alphabet = byte_alphabet()
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.bytes = [bytes(alphabet[c] for c in name) if all(c in alphabet for c in name) else name.encode() for name in names]
        # with a token for every byte, and no step before that changes the text, tokens always give the text again
        self.exact = self.tokenizer.normalizer is None and set(alphabet) <= set(names) and not getattr(self.tokenizer.pre_tokenizer, "add_prefix_space", True)


class Pieces:
    """Ids by a sentencepiece vocabulary, which puts a space before the text.

    No piece of such a vocabulary goes on after a space, apart from runs of spaces, so the words of a text with single spaces only are encoded
    apart and remembered, up to a bound in bytes. Other texts, and all texts where the vocabulary has such pieces, are encoded whole. Texts
    and words that their pieces do not give back get no ids.
    """

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.tool = SentencePieceProcessor(model_file=path)
        names = [self.tool.id_to_piece(i) for i in range(self.tool.vocab_size())]
        self.bytes = [bytes([int(name[3:5], 16)]) if self.tool.is_byte(i) else name.replace(MARK, " ").encode() for i, name in enumerate(names)]
        self.kind = np.dtype("<u2" if len(names) <= 1 << 16 else "<u4")
        self.by_word = not any(MARK in name[1:] and name.strip(MARK) for name in names)
        self.starts = np.array([name.startswith(MARK) for name in names])
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _ids(self, text: str) -> tuple[np.ndarray, bool]:
        """Ids, and whether their bytes are the space and the text."""
        ids = self.tool.encode(text, num_threads=1)
        return np.array(ids, self.kind), b"".join(map(self.bytes.__getitem__, ids)) == b" " + text.encode()

    def _whole(self, text: str) -> bytes:
        ids, same = self._ids(text)
        return ids.tobytes() if same else b""

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words without spaces, encoded together some at a time; a piece that starts with a space starts a word."""
        found = {}
        for low in range(0, len(words), WORDS):
            some = words[low : low + WORDS]
            ids, same = self._ids(" ".join(some))
            cuts = np.flatnonzero(self.starts[ids])
            if not same or len(cuts) != len(some):
                found.update((word, self._whole(word)) for word in some)
                continue
            data, ends = ids.tobytes(), (np.append(cuts, len(ids)) * self.kind.itemsize).tolist()
            found.update((word, data[a:b]) for word, a, b in zip(some, ends, ends[1:]))
        return found

    def encode_all(self, texts: list[str]) -> list[bytes]:
        parts, gaps, missing = [], [], {}
        look_up = self.known.get
        for text in texts:
            words = text.split(" ")
            if not self.by_word or "" in words or MARK in text:
                parts.append([self._whole(text)])
                continue
            found = list(map(look_up, words))
            parts.append(found)
            at = -1
            try:
                while True:
                    at = found.index(None, at + 1)
                    missing[words[at]] = b""
                    gaps.append((found, at, words[at]))
            except ValueError:
                pass
        new = self._words(list(missing))
        if self.held < REMEMBERED_BYTES:
            self.known.update(new)
            self.held += sum(map(len, new)) + sum(map(len, new.values())) + ENTRY_BYTES * len(new)
        for found, at, word in gaps:
            found[at] = new[word]
        return list(map(b"".join, parts))


def steps(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """For every link of two token rows that end together, from the first on, what follows: A_ON, B_ON, or BOTH at the end of a group."""
    bytes_a, bytes_b = ends_a.astype("<i8").tobytes(), ends_b.astype("<i8").tobytes()
    list_a, list_b = ends_a.tolist(), ends_b.tolist()
    found = bytearray()
    i = j = 0
    n = len(list_a)
    while i < n:
        if list_a[i] == list_b[j]:
            at, shift, size = 8 * i, 8 * (j - i), 8
            while bytes_a[at : at + size] == bytes_b[at + shift : at + shift + size] and at < 8 * n:
                at += size
                size *= 2
            while size > 8:
                size //= 2
                if bytes_a[at : at + size] == bytes_b[at + shift : at + shift + size]:
                    at += size
            at = min(at // 8, n)
            found += b"\3" * (at - i)
            i, j = at, at + shift // 8
            if i >= n:
                break
        x, y = list_a[i], list_b[j]
        while x != y:
            if x < y:
                found.append(A_ON)
                i += 1
                x = list_a[i]
            else:
                found.append(B_ON)
                j += 1
                y = list_b[j]
        found.append(BOTH)
        i += 1
        j += 1
    return np.frombuffer(found, np.uint8)


class Aligner:
    """Both encoders, and the tables by id that alignment needs."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b))
        n_a, n_b = len(self.a.bytes), len(self.b.bytes)
        written = ((range(n_a), b"%d,"), (range(n_a), b"%d|"), (range(n_b), b"%d,"), (range(n_b), b"%d;"))
        self.written = [form % i for ids, form in written for i in ids]
        self.first_b = 2 * n_a

    def encoded(self, texts: list[str], sizes: list[int]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides; empty for texts whose bytes do not come back. ``sizes`` are the texts' own, in bytes."""
        spaced = [" " + text for text in texts]
        rows_a = [np.frombuffer(x, self.a.kind) for x in self.a.encode_all(spaced)]
        rows_b = [np.frombuffer(x, self.b.kind) for x in self.b.encode_all(texts)]
        none = np.zeros(0, self.a.kind)
        for i, (a, b, size) in enumerate(zip(rows_a, rows_b, sizes)):
            same = size and self.sizes_a[a].sum() == self.sizes_b[b].sum() == size + 1
            if not same or not self.a.exact and b"".join(map(self.a.bytes.__getitem__, a.tolist())) != spaced[i].encode():
                rows_a[i] = rows_b[i] = none
        return rows_a, rows_b

    def aligned(self, texts: list[str], sizes: list[int], as_text: bool) -> Iterator[tuple]:
        """(n_a, n_b, n_groups, groups, links as id pairs: A << 32 | B) of each text."""
        rows_a, rows_b = self.encoded(texts, sizes)
        ids_a, ids_b = (np.concatenate([*rows, np.zeros(0, np.uint16)]).astype(np.int64) for rows in (rows_a, rows_b))
        moves = steps(np.cumsum(self.sizes_a[ids_a]), np.cumsum(self.sizes_b[ids_b]))
        ends = moves == BOTH
        at_a = np.cumsum(moves & 1, dtype=np.int64) - (moves & 1)
        at_b = np.cumsum(moves >> 1, dtype=np.int64) - (moves >> 1)
        pairs = (ids_a[at_a] << 32) | ids_b[at_b]
        # ids in the order in which the groups are written: those of A, then those of B
        last_a, last_b = at_a[ends], at_b[ends]
        group_a, group_b = (np.searchsorted(last, np.arange(len(ids))) for last, ids in ((last_a, ids_a), (last_b, ids_b)))
        order = np.zeros(len(ids_a) + len(ids_b), np.int64)
        closes_a, closes_b = (np.zeros(len(ids), np.int64) for ids in (ids_a, ids_b))
        closes_a[last_a], closes_b[last_b] = len(self.a.bytes), len(self.b.bytes)
        before_b = np.append(0, last_b + 1)
        order[np.arange(len(ids_a)) + before_b[group_a]] = ids_a + closes_a
        order[np.arange(len(ids_b)) + last_a[group_b] + 1] = self.first_b + ids_b + closes_b
        text_a, text_b = (np.append(0, np.cumsum([len(x) for x in rows])) for rows in (rows_a, rows_b))
        text_links = np.searchsorted(at_a, text_a)
        text_groups = np.searchsorted(last_a, text_a)
        order = order.tolist()
        for i in range(len(texts)):
            if text_a[i] == text_a[i + 1]:
                yield 0, 0, 0, "", pairs[:0]
                continue
            written = b"".join(map(self.written.__getitem__, order[text_a[i] + text_b[i] : text_a[i + 1] + text_b[i + 1]]))[:-1]
            groups = written.decode() if as_text else hashlib.sha256(written).hexdigest()
            n_a, n_b, n_groups = (int(x[i + 1] - x[i]) for x in (text_a, text_b, text_groups))
            yield n_a, n_b, n_groups, groups, pairs[text_links[i] : text_links[i + 1]]


@cache
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker process and pair of vocabularies."""
    return Aligner(path_a, path_b)


def align(
    docs: DataFrame, path_a: str, path_b: str, text: str = "text", keep_text: bool = True, as_text: bool = True, most: int = CHUNK_BYTES
) -> DataFrame:
    """All rows of ``docs`` with n_a, n_b, n_groups, n_links, n_best, count_sum (bigint) and groups.

    ``path_a`` is a byte-level vocabulary for the tokenizers library and encodes space and text; ``path_b`` is for sentencepiece, which adds the
    space. ``groups`` lists the ids of each group as ``a1,a2|b1;a3|b2,b3``; without ``as_text`` it is the SHA-256 of that list, which is
    much shorter. Texts that are null, empty, or do not come back from their tokens' bytes have zeros and an empty ``groups``. The count of a
    pair of ids is the number of rows that hold it linked, rows that repeat an id or a text included; ``n_best`` are the links whose count is
    the highest of any pair with their A id, ties included. Columns with the name of a result are replaced.
    """
    kept = without(docs, *RESULTS, *([] if keep_text else [text]))
    names = kept.columns
    numbered = docs.select(*[F.col(f"`{name}`").alias(f"c{i}") for i, name in enumerate(names)], F.col(f"`{text}`").alias("text"))
    stored = store(_encoded(numbered, path_a, path_b, as_text, most), "aligned")
    counts = keys_of(stored, "held").groupBy("key").agg(F.sum("held").alias("count"))
    counts = store(counts.withColumn("a", F.shiftright("key", 32).cast("int")), "pair-counts")
    best = counts.groupBy("a").agg(F.max("count").alias("best"))  # a row per id of A at most
    counts = counts.join(F.broadcast(best), "a").select("key", "count", (F.col("count") == F.col("best")).alias("is_best"))
    values = keys_of(stored).join(counts, "key").select("chunk", "pos", "count", "is_best")
    found = _counted(stored.drop("keys", "held"), values)
    return found.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(names)], *RESULTS)


def _encoded(rows: DataFrame, path_a: str, path_b: str, as_text: bool, most: int) -> DataFrame:
    """The columns of ``rows`` but the text, the tokens' facts, ``uses`` (a row's pairs by number, and how often each is linked), and by chunk its pairs."""
    facts = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string"
    schema = StructType([*rows.drop("text").schema, *StructType.fromDDL(f"{facts}, uses binary, chunk bigint, keys array<bigint>, held array<bigint>")])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, count = aligner(path_a, path_b), 0
        for batch in batches:
            texts = batch.column("text")
            sizes = np.array([len(x or b"") for x in bytes_of(texts)], np.int64)
            for first, end in cut(sizes, most):
                rows, ids, times = [], [], []
                for low, high in cut(sizes[first:end], BATCH_BYTES):
                    part = [value or "" for value in texts.slice(first + low, high - low).to_pylist()]
                    for *told, pairs in tool.aligned(part, sizes[first + low : first + high].tolist(), as_text):
                        unique, often = np.unique(pairs, return_counts=True)
                        rows.append((*told[:3], len(pairs), told[3]))
                        ids.append(unique)
                        times.append(often)
                keys, places, held = np.unique(np.concatenate(ids), return_inverse=True, return_counts=True)
                cuts = np.cumsum([0, *map(len, ids)])
                uses = [packed(places[a:b], often) if b > a else None for a, b, often in zip(cuts, cuts[1:], times)]
                rest = [None] * (end - first - 1)
                columns = [
                    *batch.drop_columns("text").slice(first, end - first).columns,
                    *[pa.array(values, kind) for values, kind in zip(zip(*rows), [pa.int64()] * 4 + [pa.string()])],
                    pa.array(uses, pa.binary()),
                    pa.array([chunk_number(count)] * (end - first), pa.int64()),
                    pa.array([keys, *rest], pa.list_(pa.int64())),
                    pa.array([held, *rest], pa.list_(pa.int64())),
                ]
                count += 1
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(encode, schema)


def _counted(documents: DataFrame, values: DataFrame) -> DataFrame:
    """``documents`` without ``uses``, with n_best and count_sum from the counts of the pairs of their chunk."""
    schema = StructType([*documents.drop("uses", "chunk").schema, *StructType.fromDDL("n_best bigint, count_sum bigint")])

    def count(rows: pa.Table, found: pa.Table) -> pa.Table:
        counts, best = by_place(found, "count", np.int64), by_place(found, "is_best", bool)
        sums = [(0, 0)] * rows.num_rows
        for i, data in enumerate(rows.column("uses").to_pylist()):
            if data is not None:
                places, often = unpacked(data, 2)
                sums[i] = int(often[best[places]].sum()), int((counts[places] * often).sum())
        kept = rows.drop_columns(["uses", "chunk"])
        columns = [pa.array([s[i] for s in sums], pa.int64()) for i in range(2)]
        return pa.Table.from_arrays([*kept.columns, *columns], schema.names)

    return answered(documents, values, count, schema)
