"""Token ids in binary files with a shared Zstandard dictionary.

Documents are ordered by id over range partitions, encoded, and written as one compressed array each, with a dictionary that was trained on
the arrays of a bounded number of documents. A file holds the dictionary's hash, the arrays, and an index of keys, offsets and counts, so
that a single short document can be read without its neighbours. Tasks write files under names of their own and report them; only
files of successful attempts are listed.

Layout: MAGIC, 32 bytes SHA-256 of the dictionary, 1 byte width of an id; the compressed arrays; the compressed index; 8 bytes offset of the
index, 8 bytes number of documents, MAGIC. Numbers are little-endian.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from incidentry.llm.common import attempt_name, key_kind, open_folder, scratch_path, store

MAGIC = b"TOKFILE1"
HEAD, TAIL = len(MAGIC) + 33, 16 + len(MAGIC)
DICTIONARY_BYTES, SAMPLE_ROWS, SAMPLE_CHARS = 112_640, 1024, 16_384
FILE_BYTES, REMEMBERED_BYTES, ENTRY_BYTES = 256 << 20, 192 << 20, 180
READ_IDS = 1 << 20
LEVEL, GROUP = 3, 256
TWO_SPACES = re.compile(r"\s\s|\0")


class Encoder:
    """Ids of whole texts as bytes. Pieces between white space are encoded once and remembered, up to a bound in bytes.

    A byte-level tokenizer never joins what follows a single space or line feed with what stands before it, so pieces that start at
    these can be encoded apart; texts with other white space in a row are encoded as a whole. New pieces are encoded together as the
    lines of one text, where the id of the line feed marks their ends. Pieces of white space only, which could join these line feeds,
    are encoded on their own, and so is every piece if a line feed is lost all the same. Texts that hold an added token of the vocabulary,
    like <|endoftext|>, are encoded as a whole too: it becomes its one id, as by default in the library.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        feed = self._ids("\n")
        if len(feed) != 1 or not np.array_equal(self._ids("a\n b\nc"), np.concatenate([self._ids(x) for x in ("a", "\n", " b", "\n", "c")])):
            raise ValueError("the tokenizer joins words over white space")
        self.feed = int(feed[0])
        self.known: dict[str, bytes] = {"": b"", "\n": feed.tobytes()}
        self.held = 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _encoded(self, pieces: list[str]) -> dict[str, bytes]:
        ids = self._ids("\n".join(pieces))
        ends = np.append(np.flatnonzero(ids == self.feed), len(ids)) * self.width
        if len(ends) != len(pieces):
            return {piece: self._ids(piece).tobytes() for piece in pieces}
        data, starts = ids.tobytes(), [0, *(ends[:-1] + self.width).tolist()]
        return {piece: data[a:b] for piece, a, b in zip(pieces, starts, ends.tolist(), strict=True)}

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. One look-up for each piece; what is missing in any of the texts is encoded in one go."""
        look_up, parts, gaps = self.known.get, [], []
        missing: dict[str, bytes] = {}
        for text in texts:
            if TWO_SPACES.search(text) or any(token in text for token in self.added):
                parts.append([self._ids(text).tobytes()])
                continue
            pieces = text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")
            found = list(map(look_up, pieces))
            at = -1
            try:
                while True:
                    at = found.index(None, at + 1)
                    missing[pieces[at]] = b""
                    gaps.append((found, at, pieces[at]))
            except ValueError:
                parts.append(found)
        if missing:
            # at the end of a text, or all of it; it would run into the next line or the one before
            spaces = {piece: self._ids(piece).tobytes() for piece in missing if piece.isspace()}
            missing = spaces | self._encoded([piece for piece in missing if piece not in spaces])
            size = sum(map(len, missing)) + sum(map(len, missing.values())) + ENTRY_BYTES * len(missing)
            if self.held + size <= REMEMBERED_BYTES:
                self.known.update(missing)
                self.held += size
        for found, at, piece in gaps:
            found[at] = missing[piece]
        return [b"".join(found) for found in parts]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def train(docs: DataFrame, tokenizer: str, end_id: int, id: str, text: str) -> bytes:
    """A dictionary from at most SAMPLE_ROWS arrays of texts of at most SAMPLE_CHARS, spread over the table; empty if too little is there."""
    share = F.pmod(F.xxhash64(F.col(f"`{id}`")), F.lit(max(1, docs.count() // SAMPLE_ROWS))) == 0
    rows = docs.where(share).select(F.substring(F.col(f"`{text}`"), 1, SAMPLE_CHARS)).limit(SAMPLE_ROWS).collect()
    tool = encoder(tokenizer)
    samples = [data + np.array([end_id], tool.kind).tobytes() for data in tool.encode_all([row[0] or "" for row in rows])]
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    if len(samples) < 16 or size < 1024:
        return b""
    return zstandard.train_dictionary(size, samples).as_bytes()


class Writer:
    """One file that is being written."""

    def __init__(self, files, root: str, name: str, dictionary: bytes, width: int) -> None:
        self.name, self.keys, self.offsets, self.counts = name, [], [], []
        self.out = files.open_output_stream(f"{root}/{name}", compression=None)
        self.at = self.out.write(MAGIC + hashlib.sha256(dictionary).digest() + bytes([width]))

    def add(self, key, frame: bytes, count: int) -> None:
        self.keys.append(key)
        self.offsets.append(self.at)
        self.counts.append(count)
        self.at += self.out.write(frame)

    def drop(self) -> None:
        """End a file that will not be listed."""
        self.out.close()

    def close(self) -> tuple[str, int, int]:
        """Name, documents and ids of the file."""
        parts = [json.dumps(self.keys).encode(), np.array(self.offsets, "<u8").tobytes(), np.array(self.counts, "<u8").tobytes()]
        self.out.write(zstandard.ZstdCompressor().compress(struct.pack("<Q", len(parts[0])) + b"".join(parts)))
        self.out.write(struct.pack("<QQ", self.at, len(self.keys)) + MAGIC)
        self.out.close()
        return self.name, len(self.keys), sum(self.counts)


class Reader:
    """A file opened for reading: its keys, and any document's ids by its place."""

    def __init__(self, files, path: str, dictionary: bytes) -> None:
        self.source = files.open_input_file(path)
        size = self.source.size()
        head, tail = self.source.read_at(HEAD, 0), self.source.read_at(TAIL, size - TAIL)
        if head[:8] != MAGIC or tail[16:] != MAGIC:
            raise ValueError(f"{path} is no token file, or it is incomplete")
        if head[8:40] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} needs another dictionary")
        self.kind = np.dtype(f"<u{head[40]}")
        at, n = struct.unpack("<QQ", tail[:16])
        index = zstandard.ZstdDecompressor().decompress(self.source.read_at(size - TAIL - at, at))
        end = 8 + struct.unpack("<Q", index[:8])[0]
        self.keys = json.loads(index[8:end])
        self.offsets = np.frombuffer(index, "<u8", n, end)
        self.counts = np.frombuffer(index, "<u8", n, end + 8 * n)
        self.ends = np.append(self.offsets[1:], np.uint64(at)) if n else self.offsets
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.unpacker = zstandard.ZstdDecompressor(dict_data=shared)

    def ids(self, place: int) -> np.ndarray:
        start, end = int(self.offsets[place]), int(self.ends[place])
        return np.frombuffer(self.unpacker.decompress(self.source.read_at(end - start, start)), self.kind)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all rows in ascending order of their ids (nulls last) and return the files: file, part, seq, docs, tokens, start.

    A null text counts as empty; every document ends with ``end_id``. Rows that repeat an id are all written, in the order of their texts' hashes.
    ``start`` is the number of ids in the files before. Ids are whole numbers or anything that can be written as text and read back from it; no
    other column of ``docs`` is kept, so none can clash. The dictionary lies beside the files as ``dictionary.zdict``.
    """
    spark = docs.sparkSession
    dictionary = train(docs, tokenizer, end_id, id, text)
    files, root = open_folder(folder)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/dictionary.zdict", compression=None) as out:
        out.write(dictionary)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("key").asc_nulls_last(), F.col("tie")]
    written = F.col(f"`{id}`").cast(key_kind(docs.select(id).dtypes[0][1]))
    rows = docs.select(
        F.col(f"`{id}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("tie"), F.col(f"`{text}`").alias("text"), written.alias("written")
    )
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        files, root = open_folder(folder)
        tool = encoder(tokenizer)
        end = np.array([end_id], tool.kind).tobytes()
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        done, writer = [], None
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, GROUP):
                    rows = batch.slice(at, GROUP)
                    arrays = tool.encode_all([value or "" for value in rows.column(2).to_pylist()])
                    for key, data in zip(rows.column(3).to_pylist(), arrays):
                        if writer is None or writer.at >= FILE_BYTES:
                            done += [writer.close()] if writer else []
                            writer = Writer(files, root, attempt_name("tokens", ".tok"), dictionary, tool.width)
                        data += end
                        writer.add(key, packer.compress(data), len(data) // tool.width)
            done += [writer.close()] if writer else []
        except BaseException:
            if writer:
                writer.drop()
            raise
        yield pa.RecordBatch.from_pylist(
            [{"file": f, "part": part, "seq": i, "docs": n, "tokens": t} for i, (f, n, t) in enumerate(done)],
            schema=pa.schema([("file", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64())]),
        )

    listed = store(rows.mapInArrow(archive, "file string, part int, seq int, docs bigint, tokens bigint"), "token-files")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return listed.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read(spark: SparkSession, folder: str, listed: DataFrame, kind: str = "bigint", with_ids: bool = True) -> DataFrame:
    """Documents of the listed files: key, start, n_tokens, ids_crc32, ids; ``start`` counts the ids of all documents before.

    Without ``with_ids`` the ids are read and counted, but the column is empty.
    """

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_folder(folder)
        with files.open_input_stream(f"{root}/dictionary.zdict", compression=None) as source:
            dictionary = source.read()
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = Reader(files, f"{root}/{name}", dictionary)
                rows: list = []
                held = 0
                for place, key in enumerate(reader.keys):
                    ids = reader.ids(place).astype("<u4")
                    rows.append((key, start, len(ids), zlib.crc32(ids.tobytes()), ids if with_ids else none))
                    start += len(ids)
                    held += len(rows[-1][4])
                    if held >= READ_IDS or len(rows) >= 1000:
                        yield _documents(rows, arrow_kind)
                        rows, held = [], 0
                if rows:
                    yield _documents(rows, arrow_kind)

    written, none = key_kind(kind), np.zeros(0, "<u4")
    arrow_kind = {"bigint": pa.int64(), "string": pa.string()}[written]
    parts = 2 * spark.sparkContext.defaultParallelism
    source = listed.select("file", "start").repartition(parts, "file")
    rows = source.mapInArrow(documents, f"key {written}, start bigint, n_tokens bigint, ids_crc32 bigint, ids array<int>")
    return rows.withColumn("key", F.col("key").cast(kind))


def _documents(rows: list, kind: pa.DataType) -> pa.RecordBatch:
    ends = np.cumsum([0, *[len(row[4]) for row in rows]])
    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([row[4] for row in rows]).astype(np.int32)))
    columns = [pa.array([row[i] for row in rows], each) for i, each in enumerate((kind, pa.int64(), pa.int64(), pa.int64()))]
    return pa.RecordBatch.from_arrays([*columns, ids], ["key", "start", "n_tokens", "ids_crc32", "ids"])


def round_trip(
    docs: DataFrame, tokenizer: str, end_id: int = 0, id: str = "doc_id", text: str = "text", with_ids: bool = True
) -> DataFrame:
    """Write ``docs`` to a new folder of the shared one and read the documents back from the files."""
    folder = scratch_path(docs.sparkSession, "tokens")
    listed = write(docs, folder, tokenizer, end_id, id, text)
    return read(docs.sparkSession, folder, listed, docs.select(id).dtypes[0][1], with_ids)
