"""Index versions: written beside each other, one small pointer decides which is read."""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import VECTORS

TABLES = ("documents", "chunks", "edges", "cards", "vectors", "doc_state", "keywords/postings", "keywords/doc_stats", "keywords/term_stats", "keywords/corpus_stats")
SCHEMA_VERSION = "index_manifest_v1"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def read_manifest(spark: SparkSession, root: str) -> dict | None:
    fs, p = _fs(spark, f"{root}/manifest.json")
    if not fs.exists(p):
        return None
    found = json.loads("\n".join(r[0] for r in spark.read.text(f"{root}/manifest.json").collect()))
    if not isinstance(found, dict) or found.get("schema_version") != SCHEMA_VERSION:
        raise ValueError("manifest is not of a known version")
    return found


def current(spark: SparkSession, root: str, embedding_model: str | None = None) -> str:
    """Folder of the published version. Queries embedded by another model than the index must not be answered from it."""
    m = read_manifest(spark, root)
    if m is None:
        raise FileNotFoundError(f"nothing is published in {root}")
    if embedding_model is not None and m["embedding_model"] != embedding_model:
        raise ValueError(f"index vectors are by {m['embedding_model']}, queries by {embedding_model}")
    return f"{root}/versions/{m['version']}"


def vectors(spark: SparkSession, folder: str, route: str) -> DataFrame:
    """A route's vectors in a version's folder; an index without any has an empty table."""
    fs, p = _fs(spark, f"{folder}/vectors")
    rows = spark.read.schema(VECTORS).parquet(f"{folder}/vectors") if fs.exists(p) else spark.createDataFrame([], VECTORS)
    return rows.where(F.col("route") == route)


def adopt(spark: SparkSession, root: str, facts: dict) -> str | None:
    """Makes tables that stand in ``root`` itself, as written before there were versions, the first version; None if there are none or a version is published."""
    fs, chunks = _fs(spark, f"{root}/chunks")
    if read_manifest(spark, root) is not None or not fs.exists(chunks):
        return None
    folder = f"{root}/versions/00000000T000000-adopted"
    for name in TABLES:
        (_, old), (_, new) = _fs(spark, f"{root}/{name}"), _fs(spark, f"{folder}/{name}")
        if fs.exists(old):
            fs.mkdirs(new.getParent())
            fs.rename(old, new)
    _swap(spark, f"{root}/manifest.json", json.dumps(facts | {"schema_version": SCHEMA_VERSION, "version": folder.rsplit("/", 1)[1]}))
    return folder


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], facts: dict, checks: DataFrame | None = None, keep: int = 2) -> str:
    """Writes a version, checks it, moves the pointer in one rename, then drops old versions. A failure leaves the pointer and removes what was written."""
    version = dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%S") + "-" + uuid.uuid4().hex[:8]
    folder = f"{root}/versions/{version}"
    fs, target = _fs(spark, folder)
    try:
        if checks is not None:
            bad = checks.limit(5).collect()
            if bad:
                raise ValueError(f"index is not whole: {[tuple(r) for r in bad]}")
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
        facts = facts | {"schema_version": SCHEMA_VERSION, "version": version, "published_at": dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")}
        _swap(spark, f"{root}/manifest.json", json.dumps(facts, ensure_ascii=False))
    except Exception:
        fs.delete(target, True)
        raise
    _, versions = _fs(spark, f"{root}/versions")
    for s in sorted((s.getPath() for s in fs.listStatus(versions)), key=lambda p: p.getName())[:-keep]:
        fs.delete(s, True)
    return folder


def _swap(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark._jvm
    fs, final = _fs(spark, path)
    _, draft = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(draft, final, overwrite)


def previews(chunks: DataFrame) -> DataFrame:
    """``doc_id, html``: a page per document with its chunks, escaped."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    one = F.concat(F.lit("<section><h2>"), F.col("chunk_index").cast("string"), F.lit(" "), esc(F.col("heading_path")), F.lit("</h2><p>"), F.col("token_size").cast("string"), F.lit(" tokens</p><pre>"), esc(F.col("text")), F.lit("</pre></section>"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", one.alias("h")))), lambda x: x.h), "\n")
    return chunks.groupBy("doc_id").agg(body.alias("body")).select("doc_id", F.concat(F.lit('<!doctype html><html><head><meta charset="utf-8"></head><body>\n'), "body", F.lit("\n</body></html>")).alias("html"))
