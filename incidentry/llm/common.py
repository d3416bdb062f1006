"""Helpers that the operators of this folder share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentry.session import scratch_path

UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
TO_LOWER = bytes.maketrans(UPPER, LOWER)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Working column names that none of the columns of ``df`` has, whatever their case."""
    taken = {name.lower() for name in df.columns}
    made = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        made.append(name)
    return made


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that a result column would clash with."""
    clashing = {name.lower() for name in names}
    return df.select(*[F.col(f"`{name}`") for name in df.columns if name.lower() not in clashing])


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write once to the shared folder and read back, so that later jobs and lost executors start from the files; with the path."""
    path = scratch_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def store(df: DataFrame, name: str) -> DataFrame:
    return stored(df, name)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that no later step reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries started inside remove their shuffle files when they end; what they have written replaces these."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def release() -> None:
    """Give back memory that a worker has used and freed, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def bytes_of(column: pa.Array) -> list:
    """Texts as UTF-8 bytes, nulls as None."""
    return column.cast(pa.large_binary()).to_pylist()


def key_kind(kind: str) -> str:
    """What a key of this type is written as: whole numbers as bigint, all others as text."""
    return "bigint" if kind in ("tinyint", "smallint", "int", "bigint") else "string"


def text_bytes(text: Column) -> Column:
    """UTF-8 length, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and plain path of a shared folder, for tasks that write or read binary files."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def attempt_name(stem: str, suffix: str) -> str:
    """A file name that no other task or attempt uses; the manifest of the successful attempts decides which files count."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return f"{stem}-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}{suffix}"
