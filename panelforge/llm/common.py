"""Helpers shared by the training-data operators: shared-folder tables and key handling."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping
from contextlib import suppress

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SALTS = 32  # parts into which the rows of a key are split
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # delete a query's shuffle files when it is done
_made: list[str] = []  # paths below the shared folder that are not deleted yet


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only where that setting is absent and Spark runs on one
    machine (tests) is a temporary folder made and remembered in the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = spark.conf.get("panelforge.shared.dir", None)
        if not root:
            root = "file://" + tempfile.mkdtemp(prefix="panelforge-")
            spark.conf.set("panelforge.shared.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    _made.append(f"{shared_root(spark)}/panelforge/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def table(df: DataFrame, name: str, options: Mapping[str, str] | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` as a Parquet table in the shared folder, with the writer's ``options``, and read it again, which cuts its lineage.

    What it shuffled on the way is deleted at once, not when the driver happens to collect garbage.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").options(**dict(options or {})).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete tables of the shared folder that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
        if p in _made:
            _made.remove(p)


def made() -> list[str]:
    """What this session still has in the shared folder, oldest first: the tables behind results that operators returned."""
    return list(_made)


def clear(spark: SparkSession, before: Iterable[str] = ()) -> None:
    """Delete all that ``made`` lists except ``before``: call it when the results are written or collected."""
    keep = set(before)
    forget(spark, [p for p in _made if p not in keep])


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with as many ``_`` behind it as it takes to differ from the names in ``taken`` (case ignored, as Spark does)."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def with_least(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``rows`` with ``least`` (the smallest ``value`` among those of equal ``keys``) and ``times`` (how many they are).

    A key may hold a third of all rows, so its rows are dealt in ``SALTS`` parts for aggregating and joining; only
    the parts' sums meet. ``rows`` is read twice.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(SALTS)))
    parts = salted.groupBy(*keys, "_salt").agg(F.min(value).alias("_least"), F.count("*").alias("_times"))
    whole = Window.partitionBy(*keys)
    found = parts.select(*keys, "_salt", F.min("_least").over(whole).alias("least"), F.sum("_times").over(whole).alias("times"))
    return salted.join(found, [*keys, "_salt"]).drop("_salt")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000) -> SparkSession:
    """Whole texts go to Python in batches of at most ``rows``: the session's limit is lowered if it is higher."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, rows)
    return spark


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; when it is through, what it freed goes back to the system. Python workers wait for their next task
    with all the memory that their last one touched, beside those of other stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # there is no such call outside of glibc
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped
