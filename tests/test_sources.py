import json
import sys

import pytest

from tessellum import config, providers
from tessellum.sources import documents, html, publish, word


def test_word_files_become_html(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(b"hello")
    files = documents.word_files(spark, str(tmp_path))
    fake = (sys.executable, "-c", "import sys, pathlib; pathlib.Path(sys.argv[1], 'x.html').write_text('<p>' + pathlib.Path(sys.argv[2]).read_text() + '</p>')", "{folder}", "{file}")
    assert [r["html"] for r in word.to_html(files, fake).collect()] == ["<p>hello</p>"]
    for broken in ((sys.executable, "-c", "import sys; sys.exit('no licence')"), (sys.executable, "-c", "")):
        with pytest.raises(Exception, match="no licence|no page"):
            word.to_html(files, broken).collect()


MHTML = """MIME-Version: 1.0
Content-Type: multipart/related; boundary="B"

--B
Content-Type: text/html; charset=utf-8

<html><body><p>Text</p><img src="cid:one"></body></html>
--B
Content-Type: image/png
Content-ID: <one>
Content-Transfer-Encoding: base64

iVBORw==
--B--
"""


def test_assets_and_manifests(spark, tmp_path):
    folder = tmp_path / "in" / "sub"
    folder.mkdir(parents=True)
    (folder / "Export.doc").write_text(MHTML)
    done = html.preprocess(documents.word_files(spark, str(tmp_path / "in")))
    written = word.write_assets(done, str(tmp_path / "assets")).collect()
    assert {r["reference"] for r in written} >= {"one"} and all(open(r["path"], "rb").read() == b"\x89PNG" for r in written)
    records = word.source_records(done, str(tmp_path / "in"), "/html", "/md")
    word.write_manifest(spark, records, str(tmp_path / "manifest.json"), "documents", "source_path")
    said = json.loads((tmp_path / "manifest.json").read_text())["documents"]
    assert [r["source_relative_path"] for r in said] == ["sub/Export.doc"] and said[0]["source_file_type"] == "doc" and said[0]["markdown_path"] == "/md/sub/Export.md"
    assert [r["key"] for r in documents.source_manifest(spark, str(tmp_path / "manifest.json")).collect()] == ["/md/sub/export.md"]


def test_providers_by_name():
    assert providers.embedder("hash-32").size == 32
    with pytest.raises(ValueError):
        providers.embedder("unknown-1")
    assert providers.text_model("reranker", None) is None
    with pytest.raises(ValueError):
        providers.text_model("annotator", None, needed=True)
    providers.register("echo", lambda key: key)
    assert providers.text_model("echo", "k") == "k"


def test_prompts_come_from_files_or_defaults(tmp_path):
    (tmp_path / "p.md").write_text("own", encoding="utf-8")
    own, default = config.prompt(str(tmp_path / "p.md"), "built in"), config.prompt(str(tmp_path / "none.md"), "built in")
    assert own[0] == "own" and default[0] == "built in" and own[1] != default[1]


def test_tables_from_before_versions_are_adopted(spark, tmp_path):
    root = str(tmp_path)
    assert publish.adopt(spark, root, {}) is None
    spark.range(3).write.parquet(f"{root}/chunks")
    folder = publish.adopt(spark, root, {"embedding_model": "hash-64"})
    assert publish.current(spark, root, "hash-64") == folder and spark.read.parquet(f"{folder}/chunks").count() == 3
    assert publish.adopt(spark, root, {}) is None and publish.vectors(spark, folder, "content").count() == 0
