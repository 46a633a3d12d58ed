import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def rows(documents):
    """(doc_id, text) of all documents."""
    return [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows and columns whose names the operators use inside."""
    long = "\n".join(f"line {i} of a very long text with words w{i} x{i * 7} y{i % 13}" for i in range(6000))
    data = [
        (1, "one two three four five six", "en", "a", 27), (2, "one two three four five six", "en", "a", 27), (3, "", "en", None, 0), (4, None, None, "a", None),
        (5, " \n\t ", "en", "a", 4), (None, "one two three four five six", "en", "a", 27), (None, None, None, None, None), (6, long, "en", "b", len(long)),
        (7, "x", None, "b", 1), (7, "x", None, "b", 1), (7, "another text under the same number", "en", "b", 34), (8, "Ünï — 漢字 😀  \x1c tabs\t\ttoo  ", "de", "b", 20),
    ]
    clash = {c: 0 for c in ("id", "key", "cluster", "component", "component_id", "kept", "n_shingles", "bi", "bj", "blk", "ids", "decoded", "score", "predicted", "held_out", "lang_pred", "n_lines", "n_removed", "n_links", "toxic", "item_id", "start", "sig", "_marks", "_doc", "n_tokens", "tie", "line")}
    from pyspark.sql import functions as F

    return spark.createDataFrame(data, DOCS).withColumns({c: F.lit(v) for c, v in clash.items()})
