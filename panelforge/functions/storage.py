"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def _checkpoint_dir(spark: SparkSession) -> str:
    """Spark's checkpoint folder, from ``spark.checkpoint.dir``.

    Only where that setting is absent and Spark runs on one machine (tests) is a temporary folder used.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="panelforge-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, written once below the checkpoint folder and read from there."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Deletes what a query shuffled when it has run, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_lock, _cleaning = threading.Lock(), {"now": 0, "before": "false"}


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """``CLEANUP`` is on; the last of several threads sets it back."""
    with _lock:
        if not _cleaning["now"]:
            _cleaning["before"] = spark.conf.get(CLEANUP)
            spark.conf.set(CLEANUP, "true")
        _cleaning["now"] += 1
    try:
        yield
    finally:
        with _lock:
            _cleaning["now"] -= 1
            if not _cleaning["now"]:
                spark.conf.set(CLEANUP, _cleaning["before"])


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df``, written once as compressed columns below the checkpoint folder and read from there, and its path for ``forget``.

    For what several passes read in part: other than a checkpoint it holds each column by itself, and what it shuffled on the way is deleted.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    with _cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Delete what ``stored`` wrote, when nothing reads it any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder, for files that driver and executors both see."""
    return f"{_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
