"""Operator 5: token counts kept by deltas.

A batch of changes (inserts, deletes, revisions) becomes signed rows, summed by
source, language and tokenizer version, and is committed as one folder named by its
id, moved into place by a rename when it is complete; a batch whose folder exists is
never applied again, and one that broke off leaves none, so that a batch may be sent
any number of times, by several drivers too. Totals are sums over the committed batches; ``compact`` replaces
many of them by one without losing their ids. Committing and compacting at once is the
caller's to prevent.

Edge cases: a null source, language or version is a group of its own; a null count is
0; a deletion takes one document and its tokens off the group that it names; groups
whose documents and tokens both return to 0 are not reported; an empty batch is
committed and changes nothing; repeated rows in a batch count as often as they occur.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import map_batches
from .wavelet import encoder

KEYS = ["source", "lang", "tokenizer_version"]
SCHEMA = "source string, lang string, tokenizer_version string, n_docs bigint, n_tokens bigint"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def inserted(rows: DataFrame) -> DataFrame:
    """``source, lang, tokenizer_version, n_tokens`` of new documents as signed rows."""
    return rows.select(*KEYS, F.lit(1).cast("bigint").alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"))


def deleted(rows: DataFrame) -> DataFrame:
    return rows.select(*KEYS, F.lit(-1).cast("bigint").alias("n_docs"), (-F.coalesce("n_tokens", F.lit(0))).cast("bigint").alias("n_tokens"))


def revised(rows: DataFrame) -> DataFrame:
    """Rows with the new values and ``old_source, old_lang, old_tokenizer_version, old_n_tokens``: both signs in one pass."""
    kind = "array<struct<source:string,lang:string,tokenizer_version:string,n_docs:bigint,n_tokens:bigint>>"
    old = F.struct(*(F.col(f"old_{k}") for k in KEYS), F.lit(-1), -F.coalesce("old_n_tokens", F.lit(0)))
    new = F.struct(*(F.col(k) for k in KEYS), F.lit(1), F.coalesce("n_tokens", F.lit(0)))
    return rows.select(F.inline(F.array(old.cast(kind[6:-1]), new.cast(kind[6:-1]))))


def commit(spark: SparkSession, root: str, batch_id: str, signed: DataFrame) -> bool:
    """Applies a batch once. Returns False if it had been applied before.

    The sums are written beside the batches and moved into place by one rename, which
    fails if another driver was faster with the same id: then its sums stand. Sums are
    partial before the shuffle, so that a hot source sends one row per task.
    """
    folder, draft = f"{root}/batches/{batch_id}", f"{root}/drafts/{uuid.uuid4().hex}"
    fs, target = _path(spark, folder)
    if fs.exists(target) or batch_id in _compacted(spark, root):
        return False
    sums = signed.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    sums.where("n_docs <> 0 or n_tokens <> 0").write.parquet(f"{draft}/{batch_id}")
    fs.mkdirs(target.getParent())
    _, source = _path(spark, f"{draft}/{batch_id}")
    moved = not fs.exists(target) and fs.rename(source, target) and not fs.exists(_path(spark, f"{folder}/{batch_id}")[1])
    if not moved:  # a rename onto a folder that appeared meanwhile may have put ours inside it
        fs.delete(_path(spark, f"{folder}/{batch_id}")[1], True)
    fs.delete(source.getParent(), True)
    return moved


def _compacted(spark: SparkSession, root: str) -> set[str]:
    found: set[str] = set()
    fs, p = _path(spark, f"{root}/bases")
    if fs.exists(p):
        for s in fs.listStatus(p):
            name = s.getPath().toString()
            if _exists(spark, f"{name}/ids/_SUCCESS"):
                found |= set(json.loads(spark.read.text(f"{name}/ids").first()[0]))
    return found


def _live(spark: SparkSession, root: str) -> list[str]:
    """Folders whose sums make the totals: the newest base and the batches that it lacks."""
    fs, p = _path(spark, f"{root}/bases")
    bases = sorted(n for n in ([s.getPath().toString() for s in fs.listStatus(p)] if fs.exists(p) else []) if _exists(spark, f"{n}/ids/_SUCCESS"))
    gone = set(json.loads(spark.read.text(f"{bases[-1]}/ids").first()[0])) if bases else set()
    fs, p = _path(spark, f"{root}/batches")
    names = [s.getPath() for s in fs.listStatus(p)] if fs.exists(p) else []
    return [f"{n}/sums" for n in bases[-1:]] + [n.toString() for n in names if n.getName() not in gone and _exists(spark, f"{n.toString()}/_SUCCESS")]


def totals(spark: SparkSession, root: str) -> DataFrame:
    folders = _live(spark, root)
    if not folders:
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA).parquet(*folders)
    sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return sums.where("n_docs <> 0 or n_tokens <> 0")


def compact(spark: SparkSession, root: str) -> None:
    """One base in place of the committed batches; its ids are written last, and readers ignore a base without them."""
    folders = _live(spark, root)
    ids = sorted({f.rsplit("/", 1)[1] for f in folders if "/batches/" in f} | _compacted(spark, root))
    fs, p = _path(spark, f"{root}/bases")
    numbers = [int(s.getPath().getName().split("-")[0]) for s in fs.listStatus(p)] if fs.exists(p) else []
    base = f"{root}/bases/{max(numbers, default=-1) + 1:08d}-{uuid.uuid4().hex}"
    totals(spark, root).write.mode("overwrite").parquet(f"{base}/sums")
    spark.createDataFrame([(json.dumps(ids),)], "ids string").coalesce(1).write.mode("overwrite").text(f"{base}/ids")


def count(docs: DataFrame, tokenizers: dict[str, str]) -> DataFrame:
    """``doc_id, source, lang, tokenizer_version, n_tokens`` of every document under each tokenizer.

    ``tokenizers``: version to the tokenizer's file; a null text has no tokens. One pass
    over the texts encodes for all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = {version: encoder(path) for version, path in tokenizers.items()}
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                texts = b.column("text").to_pylist()
                for version, enc in encoders.items():
                    n = [len(packed) // enc.kind.itemsize for packed in enc.encode(texts)]
                    yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "source", "lang")), pa.array([version] * len(n)), pa.array(n, pa.int64())], names=["doc_id", "source", "lang", "tokenizer_version", "n_tokens"])

    columns = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text")
    return map_batches(columns, ["doc_id", "source", "lang", "text"], run, "doc_id bigint, source string, lang string, tokenizer_version string, n_tokens bigint")
