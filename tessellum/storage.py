"""Tables written to the folder that all executors share, where a plan must not be computed again or has grown too long."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder (not yet created) below the one that all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a temporary
    folder takes its place in local mode alone; elsewhere executors would not share it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "tessellum-shared")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, purpose: str, path: str | None = None, **options: str) -> DataFrame:
    """``df`` written (to the shared folder, or to ``path``) and read back: lineage ends at files that outlive executors."""
    path = path or shared_dir(df.sparkSession, purpose)
    df.write.options(**options).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def discard(*frames: DataFrame | None) -> None:
    """Deletes tables made by ``stored`` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_stored_at", None)
        if path:
            delete(df.sparkSession, path)


def bounded(df: DataFrame) -> DataFrame:
    """``df``, whose batches for Python are from now on bounded by bytes too, unless the session says otherwise: many long texts are several batches."""
    conf = df.sparkSession.conf
    if BATCH_BYTES not in conf.getAll:
        conf.set(BATCH_BYTES, "8m")
    return df


def tidied(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn`` for ``mapInArrow``; a worker, which serves further tasks, gives back what it has freed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def spread(df: DataFrame) -> DataFrame:
    """``df``, in bounded batches, dealt to all cores where its files split into fewer parts than there are cores, so that work on each row isn't left to one of them; large tables stay as they are."""
    cores = bounded(df).sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
