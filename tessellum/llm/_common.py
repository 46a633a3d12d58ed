"""Small helpers that the training-data operators share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import BATCH_BYTES, bounded, discard, shared_dir, stored, tidied  # noqa: F401  (the operators take them from here)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Shuffle files of finished steps go once the driver has collected their plans; long jobs need not wait for that to happen."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def map_batches(df: DataFrame, columns: list[str], fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over exactly ``columns``, so that nothing else leaves the scan.

    Batches are bounded by bytes too, unless the session says otherwise: many long texts
    are several batches, and one text of any length is one.
    """
    return bounded(df).select(*columns).mapInArrow(tidied(fn), schema)


class Memo(dict):
    """A bounded cache: two generations, so that frequent keys survive when the older one is dropped."""

    def __init__(self, make: Callable, bound: int):
        super().__init__()
        self.make, self.bound, self.old = make, bound, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.bound:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def forget(self) -> None:
        self.clear()
        self.old = {}


def crc_mod(column: str, n: int):
    """crc32 of the id written in decimal, modulo ``n``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n
