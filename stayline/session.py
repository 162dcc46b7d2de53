"""Where intermediate tables go, and how a lineage is cut."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folders: dict[str, str] = {}
_written: dict[str, list[str]] = {}
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_freeing = {"now": 0, "before": None, "lock": threading.Lock()}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session, where
    driver and executors share one disk, may fall back to a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder shared by all executors")
    application = context.applicationId
    if application not in _own_folders:
        _own_folders[application] = tempfile.mkdtemp(prefix="stayline-")
    return _own_folders[application]


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/stayline/{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove_staged(spark: SparkSession) -> None:
    """Delete the intermediate tables this application wrote. Call it when no result
    built on them is needed any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in _written.pop(spark.sparkContext.applicationId, []):
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def drop_staged(df: DataFrame) -> None:
    """Delete one table that ``stage`` wrote. No frame may be built on it any more."""
    spark, path = df.sparkSession, getattr(df, "_staged_at", None)
    if path:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        _written[spark.sparkContext.applicationId].remove(path)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What a query begun here shuffles is deleted when it ends, not when the driver collects garbage."""
    with _freeing["lock"]:
        if not _freeing["now"]:
            _freeing["before"] = spark.conf.get(_FREED, "false")
            spark.conf.set(_FREED, "true")
        _freeing["now"] += 1
    try:
        yield
    finally:
        with _freeing["lock"]:
            _freeing["now"] -= 1
            if not _freeing["now"]:
                spark.conf.set(_FREED, _freeing["before"])


def stage(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` once as Parquet (with ``options``) in the shared folder and return a reader of it.

    Used where a value must not change between evaluations (positions inside
    sampled range partitions) or where several jobs read one expensive result.
    A lost executor costs a re-read of files, not a recomputation.
    """
    path = new_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged._staged_at = path
    return staged


def stage_for_training(df: DataFrame, label: str) -> DataFrame:
    """``stage``, and once more over all cores if the files would leave cores idle.

    Only data of fewer partitions than cores are written twice; fits read the result
    many times.
    """
    staged = stage(df, label)
    cores = df.sparkSession.sparkContext.defaultParallelism
    if staged.rdd.getNumPartitions() < cores:
        staged = stage(staged.repartition(cores), label)
    return staged


def stage_numbered(df: DataFrame, label: str, number: str) -> DataFrame:
    """``stage_for_training`` with a row ``number``; the numbers in a file follow each other."""

    def numbered(rows: DataFrame) -> DataFrame:
        return stage(rows.withColumn(number, F.monotonically_increasing_id()), label)

    staged = numbered(df)
    cores = df.sparkSession.sparkContext.defaultParallelism
    if staged.rdd.getNumPartitions() < cores:
        staged = numbered(staged.drop(number).repartition(cores))
    return staged
