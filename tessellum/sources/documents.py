"""Markdown and Word files, lineage manifests, checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import content_hash, doc_key, last_wins
from ..functions.tokens import strip

MANIFEST = "documents array<struct<cleaned_markdown_path:string,doc_id:string,source_path:string,source_absolute_path:string,source_relative_path:string,source_file_name:string,source_file_type:string,converted_html_path:string>>"


def files(spark: SparkSession, folder: str, pattern: str, recursive: bool = True) -> DataFrame:
    """``binaryFile`` rows whose path matches, whatever the case of its suffix; a missing folder raises."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return rows.where(F.col("path").rlike(f"(?i){pattern}$"))


def word_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    return files(spark, folder, r"\.docx?", recursive)


def markdown_state(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """``doc_key, path, content_hash`` of the Markdown files."""
    rows = files(spark, folder, r"\.md", recursive)
    return rows.select(doc_key(F.col("path"), folder).alias("doc_key"), "path", content_hash(F.col("content")).alias("content_hash"))


def source_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Lineage records by ``key`` (forward slashes, trimmed, lower case), the last of each; none if there is no file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fields = MANIFEST[MANIFEST.index("<struct<") + 8 : -2].replace(":", " ").replace(",", ", ")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], f"key string, {fields}")
    rows = spark.read.schema(MANIFEST).option("multiLine", True).json(path).select(F.posexplode("documents").alias("pos", "d")).select("pos", "d.*")
    return last_wins(rows.withColumn("key", _key(F.col("cleaned_markdown_path"))), "key", "pos").drop("pos")


def _key(path: Column) -> Column:
    return F.lower(strip(F.regexp_replace(path, r"\\", "/")))


def load_markdown(spark: SparkSession, folder: str, manifest: DataFrame | None = None, only: DataFrame | None = None, recursive: bool = True) -> DataFrame:
    """Documents with text, hash and lineage; ``only``: a table of the ``doc_key`` to load.

    A manifest record is found by the full path, else by the path below ``folder``.
    """
    rows = files(spark, folder, r"\.md", recursive).select(doc_key(F.col("path"), folder).alias("doc_key"), "path", "content")
    if only is not None:
        rows = rows.join(only.select("doc_key"), "doc_key", "left_semi")
    name = F.element_at(F.split("path", "/"), -1)
    docs = rows.select(
        "doc_key", F.col("doc_key").alias("doc_id"), name.alias("file_name"), F.lit("md").alias("file_type"), F.col("path").alias("source_path"),
        content_hash(F.col("content")).alias("content_hash"), F.decode("content", "UTF-8").alias("text"),
    )
    if manifest is None:
        return docs
    tries = docs.select("doc_key", F.posexplode(F.array(_key(F.regexp_replace("source_path", "^file:/+", "/")), "doc_key")).alias("turn", "key"))
    first = tries.join(manifest, "key").groupBy("doc_key").agg(F.min_by(F.struct(*[c for c in manifest.columns if c != "key"]), "turn").alias("m"))
    joined = docs.join(first, "doc_key", "left")
    pick = lambda c, m: F.coalesce(F.col(f"m.{m}"), F.col(c)).alias(c)
    return joined.select("doc_key", pick("doc_id", "doc_id"), pick("file_name", "source_file_name"), pick("file_type", "source_file_type"), pick("source_path", "source_path"), "content_hash", "text", F.col("m.source_relative_path").alias("source_relative_path"), F.col("m.converted_html_path").alias("converted_html_path"))


def checkpoint_records(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Appended JSON lines, the last successful record of each key; blank lines and records without a key or that failed don't count."""
    rows = spark.read.schema(schema).json(path).withColumn("_at", F.struct(F.col("_metadata.file_modification_time"), F.col("_metadata.file_path"), F.monotonically_increasing_id()))
    latest = last_wins(rows, key, "_at").drop("_at")
    return latest.where("status = 'success'") if "status" in latest.columns else latest


def append_records(rows: DataFrame, path: str) -> None:
    """Append-only; readers take the last record of a key."""
    rows.write.mode("append").json(path)


def without(records: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return records.join(gone.select(key), key, "left_anti")
