"""Tables that several steps share, written as Parquet to the folder that all executors share and read back."""

from __future__ import annotations

import atexit
import contextlib
import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_paths: dict[str, SparkSession] = {}
CLEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}  # a step's shuffle files go when it has ended

# Tasks over a dataset's windows sort their rows several times, widened by what the windows collect, to many times their shuffled bytes:
# tasks of 4 MB, from shuffles cut finely enough that large inputs have them too, whatever the session merges partitions to.
# The driver holds each table that is broadcast, several at once where many rules run in one job, and the size of a Parquet file (dictionaries, runs)
# says little of its rows in memory: no table is broadcast by the size of its file, and by the size of its shuffled rows only up to 1 MB.
NARROW = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m", "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "1m",
}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where it is unset, one of the driver's, and only with local executors."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file://{_own_dir()}"


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="tickvet-")


@contextlib.contextmanager
def held(spark: SparkSession, settings: dict[str, str]):
    """Settings that hold inside, and are put back."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def fresh_path(spark: SparkSession) -> str:
    """A path in the shared folder for a table or files; what is there goes when the driver ends."""
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    _paths[path] = spark
    return path


def written(df: DataFrame, settings: dict[str, str] | None = None) -> DataFrame:
    """df, computed once: what is made of it has a short plan and survives lost executors.

    The step's shuffle files go when it has ended; the table goes by discard(), or when the driver ends.
    """
    spark = df.sparkSession
    path = fresh_path(spark)
    with held(spark, CLEAN | (settings or {})):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that written() made and nothing reads any more."""
    for table in tables:
        _delete(_paths.pop(table._written_at), table._written_at)


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _end() -> None:
    for path, spark in _paths.items():
        with contextlib.suppress(Exception):  # the session may have ended before
            _delete(spark, path)
