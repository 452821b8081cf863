"""Tables and folders that every executor can see."""

from __future__ import annotations

import ctypes
import gc
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: Bytes of text after which Spark closes a batch for a Python worker, and the setting that says so. By its own default, 64 MB, a batch
#: is a whole partition of common size, which the executor and the worker each hold, once on the way in and once on the way out.
BATCH_BYTES, BATCH_SETTING = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"

_OPEN = threading.local()

#: What this worker process has turned to last, and how what it keeps for that is let go.
_TURNED: list[tuple[str, Callable[[], None]]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for shared files. Without one there is no place that all executors are known to see, so this refuses."""
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not found:
        raise ValueError(f"{SETTING} names no folder; set it to one that the driver and all executors share")
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/quillon/{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written within go when it ends, but for those to keep."""
    outer, _OPEN.paths = getattr(_OPEN, "paths", None), []
    try:
        yield
    finally:
        paths, _OPEN.paths = _OPEN.paths, outer
        for path in paths:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the batches of the session's Python tasks by ``BATCH_BYTES``, unless the session has its own bound. Results don't depend on it."""
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def turn_to(work: str, forget: Callable[[], None]) -> None:
    """Told by a task when it begins, before it makes what its worker process keeps for later tasks.

    Spark uses a worker process for the tasks of all stages, one after the other.
    What it keeps for other work than this goes, and the memory back to the system.
    """
    if _TURNED and _TURNED[0][0] == work:
        return
    if _TURNED:
        _TURNED.pop()[1]()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)
    _TURNED.append((work, forget))


def values(column: pa.Array, step: int = 256) -> Iterator:
    """Of a column of a batch, so many at a time as Python objects; a batch of long texts is never held twice."""
    for at in range(0, len(column), step):
        yield from column.slice(at, step).to_pylist()


def materialize(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage and survives the loss of executors, since no part of the
    result lives on one of them. What is kept is the caller's to delete, with
    the folder, once the result has been read.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    if not keep and getattr(_OPEN, "paths", None) is not None:
        _OPEN.paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
