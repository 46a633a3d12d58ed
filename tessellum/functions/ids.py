"""Keys and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def node_id(doc_id: Column, chunk_index: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", doc_id, chunk_index.cast("string"), text_hash(text)), 256), 1, 24)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def doc_key(path: Column, root: str) -> Column:
    """Lower-case path below ``root`` with forward slashes."""
    clean = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^file:/+", "/")
    return F.lower(F.regexp_replace(clean, "^" + _quoted(root.replace("file://", "").rstrip("/")) + "/+", ""))


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c == "/" else "\\" + c for c in text)


def doc_key_of(metadata: dict[str, Column]) -> Column:
    """First usable of relative path, id, path and name; all but the first must name a Markdown file."""
    low = {k: F.lower(F.regexp_replace(c, r"\\", "/")) for k, c in metadata.items()}
    first = F.when(low["cleaned_markdown_relative_path"] != "", low["cleaned_markdown_relative_path"])
    rest = [F.when(low[k].endswith(".md"), low[k]) for k in ("doc_id", "file_path", "filename")]
    return F.coalesce(first, *rest, F.lit("unknown"))


def safe_name(name: Column) -> Column:
    """File name without awkward characters, told apart by a hash."""
    bare = F.regexp_replace(name, r"[^0-9A-Za-z一-鿿._-]+", "_")
    return F.concat(F.when(bare == "", F.lit("document")).otherwise(bare), F.lit("-"), F.substring(F.sha2(name, 256), 1, 8))


def cache_key(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def last_wins(df, key: str, order: str):
    """Last record of each key by ``order``; records without a key are skipped."""
    found = df.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    columns = [c for c in df.columns if c != key]
    return found.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in columns))
