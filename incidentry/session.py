"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def use_utc(spark: SparkSession) -> SparkSession:
    """Incident times carry no zone; UTC keeps conversions to epoch seconds free of daylight-saving jumps."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one when running in a single process."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir")
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="incidentry-"))
    return context.getCheckpointDir()


_MADE: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, plain: bool = False, path: str | None = None) -> DataFrame:
    """Compute once and keep as Parquet in the shared folder, so that later jobs and lost executors read it instead of its inputs.

    Shuffle files of the query go when it ends, as what it has written replaces them. ``plain`` stores numbers unpacked: files are split by
    bytes, and a split of packed ones may hold many times as much once it is read. ``path`` is a scratch path, for ``drop_scratch``.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, "settled")
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        writer = df.write
        if plain:
            writer = writer.option("compression", "none").option("parquet.enable.dictionary", "false")
        writer.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_shuffles(df: DataFrame) -> None:
    """Delete the shuffle files that the rows of ``df`` came through. They are made again if it is read again."""
    df._jdf.rdd().cleanShuffleDependencies(True)


def drop_scratch(spark: SparkSession, *paths: str) -> None:
    """Delete what is below these scratch paths, which nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for name in paths:
        _MADE.remove(name)
        path = hadoop.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this process has written below the shared folder; call it when no result that reads from there is needed any more."""
    drop_scratch(spark, *_MADE)
