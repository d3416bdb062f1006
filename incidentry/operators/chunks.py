"""Corpus counts looked up by chunks of documents.

A task cuts its documents into chunks of bounded bytes and numbers the different keys (words, pairs of ids) of each. The keys stand once, in the
first row of their chunk; a document holds numbers only. So a key meets its corpus-wide count once per chunk and not once per document: the rows
of a key that every document holds are as many as there are chunks. The counts come back to the chunk's documents by a cogroup on the chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 16 << 20


def cut(sizes: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """(first, end) of consecutive rows of together about ``most`` bytes; a larger row is a chunk of its own or ends one."""
    ends = np.cumsum(sizes)
    first, before = 0, 0
    while first < len(sizes):
        end = min(len(sizes), int(np.searchsorted(ends, before + most)) + 1)
        yield first, end
        first, before = end, int(ends[end - 1])


def chunk_number(count: int) -> int:
    """A number that no other chunk of the job has."""
    from pyspark import TaskContext

    return (TaskContext.get().partitionId() << 32) | count


_PACKER, _UNPACKER = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def packed(*columns: np.ndarray) -> bytes:
    """Numbers from 0 to 2^32 - 1, byte by byte of their value, compressed."""
    return _PACKER.compress(b"".join(column.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for column in columns))


def unpacked(data: bytes, columns: int = 1) -> list[np.ndarray]:
    raw = np.frombuffer(_UNPACKER.decompress(data), np.uint8).reshape(columns, 4, -1)
    return [np.ascontiguousarray(raw[i].T).view("<u4").ravel() for i in range(columns)]


def length(data: bytes, columns: int = 1) -> int:
    """How many numbers each column of ``packed`` has."""
    return zstandard.frame_content_size(data) // (4 * columns)


def keys_of(stored: DataFrame, *beside: str) -> DataFrame:
    """(chunk, pos, key, *beside): a row for each key of a chunk, from its columns ``keys`` and ``beside``, arrays of one length."""
    rows = stored.where("keys is not null").select("chunk", F.posexplode(F.arrays_zip("keys", *beside)).alias("pos", "each"))
    return rows.select("chunk", "pos", F.col("each.keys").alias("key"), *[F.col(f"each.{name}").alias(name) for name in beside])


def answered(documents: DataFrame, values: DataFrame, answer: Callable[[pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
    """``answer(documents of a chunk, values of its keys by pos)`` for every chunk."""
    values = values.withColumn("of", F.col("chunk")).drop("chunk")  # a name of its own, as both sides come from one table
    return documents.groupBy("chunk").cogroup(values.groupBy("of")).applyInArrow(answer, schema)


def by_place(values: pa.Table, name: str, kind) -> np.ndarray:
    """The column in the order of ``pos``."""
    found = np.zeros(values.num_rows, kind)
    found[np.asarray(values.column("pos"))] = np.asarray(values.column(name))
    return found
