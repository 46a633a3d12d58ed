from tessellum import streaming
from tessellum.config import IndexConfig
from tessellum.plans import build as builder
from tessellum.plans.retrieve import QueryService
from tessellum.providers import EmptyGraph, HashEmbedder, RuleAnnotator
from tessellum.sources import documents, publish


def write(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")


def test_build_update_and_query(spark, tmp_path):
    docs, root, embedder = tmp_path / "docs", str(tmp_path / "index"), HashEmbedder()
    docs.mkdir()
    write(docs, "pay.md", "# Payment\n\n## Setup\n\nCreate a merchant account first.\n\n## Errors\n\nError E1001 means a bad signature.")
    write(docs, "log.md", "# Logging\n\nLogs rotate every day and are kept for a week.")
    run = lambda: builder.build(spark, documents.load_markdown(spark, str(docs)), root, IndexConfig(), RuleAnnotator(), EmptyGraph(), embedder)
    first = run()
    chunks = {r["node_id"]: r["text"] for r in spark.read.parquet(f"{first}/chunks").collect()}
    assert any("E1001" in t for t in chunks.values())
    asked = spark.createDataFrame([(1, "What does error E1001 mean?"), (2, "How long are logs kept?")], "query_id bigint, query_text string")
    answers = {r["query_id"]: r["answer"] for r in QueryService.open(spark, root, embedder).answer(asked).answers.collect()}
    assert answers[1].splitlines()[1].startswith("- Errors [") and answers[2].splitlines()[1].startswith("- Logging [")

    write(docs, "log.md", "# Logging\n\nLogs rotate every hour and are kept for a month.")
    write(docs, "new.md", "# Backup\n\nBackups run at night.")
    (docs / "pay.md").unlink()
    run()
    now = {r["text"] for r in spark.read.parquet(f"{publish.current(spark, root)}/chunks").collect()}
    assert any("month" in t for t in now) and any("Backups" in t for t in now) and not any("E1001" in t or "week" in t for t in now)


def test_stream_applies_batches(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    write(folder, "a.md", "# A")
    changes = streaming.markdown_stream(spark, str(folder))
    for name in ("", "b.md"):
        if name:
            write(folder, name, "# B")
        streaming.apply_batches(changes, str(tmp_path / "state"), lambda batch, i: seen.extend(r["text"] for r in batch.collect())).awaitTermination()
    assert sorted(seen) == ["# A", "# B"]
