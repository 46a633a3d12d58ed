"""Queries against their SQL on small tables with what the driver's tables hardly hold."""

import time

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessellum import queries
from tessellum.functions import normalise, tokens
from tessellum.operators import bm25, chunker
from tessellum.sources import html
from tessellum.storage import BATCH_BYTES

from test_queries import plain


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    dense = " ".join(f"a{i}b,cc{i},dd{i}" for i in range(900))
    blanks = "one\x0btwo \x85three four\u2028# five\xa0 six\x1c" * 30
    texts = [dense, blanks, "last words end in\xa0", "x,yy" * 3000, "", None, "İstanbul Kelvin \u212aelvin", "plain words here", "id 7 12id34 API-2 /a/b.c x_y.z-1 Foo 1.2", "```json\n{}```  \n ", "a" * 5000 + " end"]
    docs = spark.createDataFrame([(i, t, ("en", "de", None)[i % 3], f"src{i % 4}", len(t or "")) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    tables = {"documents": docs, "benchmark": spark.createDataFrame([(1, "plain words"), (2, "istanbul"), (3, "nowhere"), (4, "words end kelvin")], "item_id bigint, text string")}
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["keyword_terms", "keyword_top_k", "markdown_chunks", "technical_tokens", "index_terms", "annotation_normalised"])
def test_odd_rows(spark, odd, name):
    found = queries.QUERIES[name](spark, odd)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{odd}/{t}.parquet/*.parquet')")
    columns = sorted(found.columns)
    r = con.execute(queries.ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(repr([plain(x[c]) for c in columns]) for x in found.collect()) == sorted(repr([plain(x[names.index(c)]) for c in columns]) for x in r.fetchall())


def test_answers_are_parsed_once(spark):
    raw = spark.createDataFrame([('{"summary": "s"}',)], "raw string")
    plan = raw.select(normalise.annotation(F.col("raw")).alias("a")).select("a.summary", "a.keywords", "a.type")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("parse_json") + plan.count("parsejson") == 1, plan


def test_long_runs_of_letters_take_linear_time():
    began = time.process_time()
    assert chunker.token_size("a" * 40_000) == 1 and tokens.cut("a" * 40_000) == ["a" * 40_000]
    assert time.process_time() - began < 2


def test_scan_finds_what_joins_find(spark, monkeypatch):
    """In several scans too, and with ties, copies and documents without tokens."""
    docs = spark.range(3000).select(F.col("id").alias("node_id"), F.when(F.col("id") % 50 > 0, F.array(F.concat(F.lit("a"), F.col("id") % 7), F.concat(F.lit("b"), F.col("id") % 11), F.concat(F.lit("c"), F.col("id") % 400))).otherwise(F.array().cast("array<string>")).alias("tokens"), (-F.col("id")).alias("corpus_pos"))
    asked = spark.createDataFrame([(i, [f"a{i}", f"b{i}", f"c{i * 9}", "none"]) for i in range(9)], "query_id bigint, tokens array<string>")
    index = bm25.build(docs)
    joined = bm25.KeywordIndex(index.postings, index.doc_stats, index.term_stats, index.corpus_stats)
    monkeypatch.setattr(bm25, "SCAN_QUERIES", 4)
    got, want = ({(r["query_id"], r["rank"]): (r["node_id"], round(r["raw_score"], 9)) for r in bm25.search(x, asked, 8).collect()} for x in (index, joined))
    assert got == want and len(got) == 72


def test_pages_reach_python_in_small_batches(spark):
    pages = spark.range(1000, numPartitions=1).select(F.col("id"), F.concat(F.lit("<p>"), F.col("id").cast("string"), F.lit("</p>")).alias("html"))
    done = html.markdown_of(pages, "html", ["id"])
    assert spark.conf.get(BATCH_BYTES) and sorted(r["markdown"] for r in done.collect()) == sorted(f"{i}\n" for i in range(1000))
    assert [b.num_rows for b in html._slices([pa.record_batch({"a": list(range(150))})])] == [64, 64, 22]


def test_headers_are_parsed_once():
    content = b'MIME-Version: 1.0\nContent-Type: multipart/related; boundary="B"\n\n--B\nContent-Type: text/html; charset=utf-8\n\n<p>x</p>\n--B\nContent-Type: image/png; name="=?utf-8?q?=C3=A4?=.png"\nContent-ID: <one>\n\nd\n--B--\n'
    html._header.cache_clear()
    page, assets = html.mhtml(content)
    assert page.strip() == "<p>x</p>" and [a[3:] for a in assets] == [("ä.png", "one")]
    assert html._header.cache_info().misses == 4  # as many as there are headers
