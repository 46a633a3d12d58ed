import json

import pytest

from tessellum.functions import normalise, tokens
from tessellum.operators import bm25, chunker, incremental, neighbours, ranking, vector
from tessellum.sources import html
from pyspark.sql import functions as F


def test_sections_start_at_headings():
    text = "# Guide\n\n" + "\n\n".join(f"## Part {i}\n\nSome words of part {i}.\n\n### Detail\n\nMore words." for i in range(3))
    found = chunker.split(text, 512, 100)
    assert len(found) >= 3 and all(sum(f"## Part {i}\n" in t for t, _ in found) == 1 for i in range(3))
    assert any("Part 1" in path for _, path in found)


def test_fences_and_tables_stay_whole():
    fence = "```\n# no heading\n\nx = 1\n```"
    table = "| a | b |\n| --- | --- |\n| 1 | 2 |"
    found = chunker.blocks(f"# H\n\n{fence}\n\n{table}\n\nend")
    assert fence in found and table in found
    assert chunker.blocks("```\nnever closed\n\nstill code")[-1].endswith("still code")
    assert chunker.split("") == [] and chunker.split("   \n ") == []


@pytest.mark.parametrize(("rule", "ok"), [("| --- | --- |", True), ("--- | :---:", True), ("| --- |", False), ("|--|--|", False), ("| --- | x |", False), ("|:---|---:|", True)])
def test_table_rules(rule, ok):
    assert chunker.is_table(["| a | b |", rule], 0) == ok
    assert not chunker.is_table(["a | b", rule], 0) and not chunker.is_table(["||", rule], 0)


def test_both_token_counters_agree(spark):
    texts = ["", "API v2 and id2 id, md. UI-kit", "/a/b.c x_y.z-1 foo.bar 12.5 e-mail@x.com", "错误码E1001 表示 api", "  `quoted` (x) [y] a b cd -- __", "Release 1.2.3 of Foo 7 and v 8", "\u3000全角 空格 id 3", "a\xa0b word\u2003 9"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tokens.token_size(F.col("t")).alias("n")).collect()
    assert {r["i"]: r["n"] for r in got} == {i: chunker.token_size(t) for i, t in enumerate(texts)}


def test_deeply_nested_inline_tags_take_linear_time():
    page = "<p>" + "<b><i>" * 200 + "deep" + "</i></b>" * 200 + "</p>" + "<div>" * 3000 + "end"
    assert "deep" in html.convert(page) and "end" in html.convert(page)


def test_long_prose_is_cut_with_overlap():
    text = "# H\n\n" + "\n\n".join(f"Paragraph number {i} with several quite ordinary words in it." for i in range(120))
    found = [t for t, _ in chunker.split(text, 128, 40)]
    assert len(found) > 5 and all(f"number {i} " in "\n".join(found) for i in range(120))


def test_chunk_table(spark):
    docs = spark.createDataFrame([("k", "d", "# A\n\ntext of a"), ("e", "e", ""), ("n", "n", None)], "doc_key string, doc_id string, text string")
    got = chunker.chunk(docs).collect()
    assert {r["doc_key"] for r in got} == {"k"} and [r["chunk_index"] for r in got] == list(range(len(got)))
    assert chunker.chunk(docs.limit(0)).collect() == []


def test_html_to_markdown():
    md = html.convert("<html><body><h1>Title</h1><p>One <b>bold</b> word.</p><ul><li>a</li><li>b</li></ul><table><tr><th>x</th><th>y</th></tr><tr><td>1</td><td>2</td></tr></table><script>no()</script><p style='display:none'>no</p></body></html>")
    assert "# Title" in md and "bold" in md and "no" not in md.replace("none", "") and "| 1 | 2 |" in md


def test_keyword_search_orders_by_rarity(spark):
    docs = spark.createDataFrame([(1, ["a", "b"], 1), (2, ["a", "c"], 2), (3, ["a"], 3), (4, [], 4)], "node_id bigint, tokens array<string>, corpus_pos bigint")
    asked = spark.createDataFrame([(7, ["a", "c"])], "query_id bigint, tokens array<string>")
    got = bm25.search(bm25.build(docs), asked, 3).orderBy("rank").collect()
    assert got[0]["node_id"] == 2 and [r["rank"] for r in got] == [1, 2, 3]


def test_vector_search(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, None), (4, [1.0]), (5, [1.0, 0.0])], "node_id bigint, embedding array<double>")
    asked = spark.createDataFrame([(9, [1.0, 0.1])], "query_id bigint, embedding array<double>")
    assert [r["node_id"] for r in vector.search(rows, asked, 5).orderBy("rank").collect()] == [2, 5, 1]
    assert vector.search(rows, asked.limit(0), 5).collect() == [] and vector.search(rows.limit(0), asked, 5).collect() == []


def test_diff_and_decision(spark):
    before, now = (spark.createDataFrame(x, "doc_key string, content_hash string") for x in ([("a", "1"), ("b", "1"), ("c", "1")], [("a", "1"), ("b", "2"), ("d", "1")]))
    changes = incremental.diff(before, now)
    assert {r["doc_key"]: r["change"] for r in changes.collect()} == {"a": "unchanged", "b": "changed", "c": "deleted", "d": "added"}
    decision = {r["doc_key"]: r for r in incremental.decide(changes, incremental.Signals()).collect()}
    assert decision["b"]["reannotate"] and decision["d"]["reembed"] and not decision["a"]["reannotate"] and not decision["c"]["reembed"]


def test_model_answers_are_normalised(spark):
    raws = ["not json", json.dumps({"summary": "s", "keywords": ["k", 3, ""], "tags": "t"}), "```json\n{\"summary\": \"fenced\"}\n```", None]
    got = spark.createDataFrame([(r,) for r in raws], "raw string").select(normalise.annotation(normalise.parsed(F.col("raw"))).alias("a")).collect()
    assert len(got) == 4 and got[1]["a"]["summary"] == "s" and got[2]["a"]["summary"] == "fenced"


@pytest.mark.parametrize(("text", "some"), [("API v2 错误码 E1001", "e1001"), ("", None)])
def test_tokens(spark, text, some):
    got = spark.createDataFrame([(text,)], "t string").select(tokens.tokens(F.col("t")).alias("x")).first()["x"]
    assert (some in got) if some else not got


def test_neighbours(spark):
    chunks = spark.createDataFrame([(i, "d", i) for i in range(5)], "node_id bigint, doc_id string, chunk_index int")
    found = spark.createDataFrame([(1, 2, 0.5, 1)], "query_id bigint, node_id bigint, s double, first_seq bigint")
    got = neighbours.expand(ranking.placed(found, "s"), chunks, 1, 5).collect()
    assert sorted(r["node_id"] for r in got) == [1, 3] and all(r["center_node_id"] == 2 for r in got)
