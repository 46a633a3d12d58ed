"""Continuous builds: a stream of document changes, applied batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def markdown_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """New Markdown files as ``path, text``."""
    return spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.md").load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def apply_batches(changes: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None], once: bool = True):
    """Runs ``apply(batch, batch_id)`` for each micro-batch; ids repeat after a failure, so ``apply`` must be idempotent by id."""
    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)
    return (writer.trigger(availableNow=True) if once else writer).start()
