"""Word files to HTML by an office program on the workers, and what a conversion leaves behind: assets and manifests."""

from __future__ import annotations

import json
import subprocess
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .publish import _fs

CONVERT = ("soffice", "--headless", "--convert-to", "html", "--outdir", "{folder}", "{file}")


def to_html(files: DataFrame, command: tuple[str, ...] = CONVERT) -> DataFrame:
    """``path, html`` of ``binaryFile`` rows. A program that fails, or that leaves no page, fails the task with what it said.

    The program needs a file: it gets one in a scratch folder that lasts as long as its
    call; nothing that is read later stands there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                with tempfile.TemporaryDirectory() as scratch:
                    file = Path(scratch, "in", Path(path).name)
                    file.parent.mkdir()
                    file.write_bytes(content or b"")
                    folder = Path(scratch, "out")
                    folder.mkdir()
                    said = subprocess.run([c.format(folder=folder, file=file) for c in command], capture_output=True, text=True, check=False)
                    if said.returncode:
                        raise RuntimeError(f"{path} was not converted: {said.stdout} {said.stderr}")
                    pages = sorted(folder.glob("*.html")) + sorted(folder.glob("*.htm"))
                    if not pages:
                        raise FileNotFoundError(f"no page came of {path}")
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([pages[0].read_text("utf-8", "ignore")])], names=["path", "html"])

    return files.select("path", "content").mapInArrow(run, "path string, html string")


def write_assets(packages: DataFrame, root: str) -> DataFrame:
    """Writes the files of ``packages(work_name, assets)`` below ``root`` and returns ``work_name, reference, path`` of each reference to one.

    Tasks write them through Arrow's file systems, each file under its own number, so a
    task that is run again writes the same ones. Empty files are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for work, assets in zip(b.column("work_name").to_pylist(), b.column("assets").to_pylist(), strict=True):
                for a in assets or ():
                    if not a["data"]:
                        continue
                    where = f"{root}/{work}/{a['file']}"
                    system, path = arrow_fs.FileSystem.from_uri(where) if "://" in where else (arrow_fs.LocalFileSystem(), where.removeprefix("file:"))
                    system.create_dir(path.rsplit("/", 1)[0])
                    with system.open_output_stream(path) as out:
                        out.write(a["data"])
                    rows += [(work, r, where) for r in dict.fromkeys(x for x in (a["reference"], a["cid"], a["name"]) if x)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["work_name", "reference", "path"])

    return packages.select("work_name", "assets").mapInArrow(run, "work_name string, reference string, path string")


def source_records(files: DataFrame, input_root: str, html_root: str, markdown_root: str) -> DataFrame:
    """Lineage of ``files(path, work_name)``: where a document came from and where its page and Markdown stand."""
    clean = F.regexp_replace("path", "^file:/+", "/")
    below = F.when(F.startswith(clean, F.lit(input_root.rstrip("/") + "/")), F.substring(clean, len(input_root.rstrip("/")) + 2, 10_000)).otherwise(F.element_at(F.split(clean, "/"), -1))
    name = F.element_at(F.split(clean, "/"), -1)
    kind = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    markdown = F.concat(F.regexp_replace(below, r"\.[^./]*$", ""), F.lit(".md"))
    return files.select(
        clean.alias("source_path"), clean.alias("source_absolute_path"), below.alias("source_relative_path"), name.alias("source_file_name"), kind.alias("source_file_type"),
        F.concat(F.lit(html_root.rstrip("/") + "/"), "work_name", F.lit(".html")).alias("converted_html_path"), F.concat(F.lit(markdown_root.rstrip("/") + "/"), markdown).alias("markdown_path"), markdown.alias("markdown_relative_path"),
        F.concat(F.lit(markdown_root.rstrip("/") + "/"), markdown).alias("cleaned_markdown_path"),
    )


def write_manifest(spark: SparkSession, rows: DataFrame, path: str, name: str, order: str) -> None:
    """One JSON file with a list ``name`` of ``rows`` in order, streamed through the driver a partition at a time."""
    fs, target = _fs(spark, path)
    out = fs.create(target, True)
    out.write(bytearray(f'{{"{name}": ['.encode()))
    for i, r in enumerate(rows.orderBy(order).toLocalIterator()):
        out.write(bytearray(((",\n" if i else "\n") + json.dumps(r.asDict(recursive=True), ensure_ascii=False)).encode()))
    out.write(bytearray(b"\n]}\n"))
    out.close()
