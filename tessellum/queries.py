"""Registered queries over the driver's tables, and the same in SQL.

``documents`` stand in for chunks (one chunk a document; source as the document,
``doc_id`` as the index within), ``benchmark`` for questions, ``embeddings`` for
vectors and ``conversations`` for ordered chunks. Edges follow from arithmetic on ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ids, normalise, scores, tokens
from .operators import answer, bm25, dependency, incremental, neighbours, ranking, vector
from .sources import html
from .storage import spread, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keywords(spark: SparkSession, sf_dir: str) -> bm25.KeywordIndex:
    """The tables of the index all come from the tokens, which are cut once and written."""
    docs = spread(table(spark, sf_dir, "documents"))
    return bm25.build(stored(docs.select(F.col("doc_id").alias("node_id"), tokens.words(F.col("text")).alias("tokens"), F.col("doc_id").alias("corpus_pos")), "keyword-tokens"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), tokens.words(F.col("text")).alias("tokens"))


_TOK = """
    tok AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))) AS token FROM documents),
    dl AS (SELECT d.doc_id, count(t.token) AS dl FROM documents d LEFT JOIN tok t USING (doc_id) GROUP BY 1),
    corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
    term AS (SELECT token, count(*) AS df FROM tok GROUP BY 1),
    idf AS (SELECT token, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM term, corpus),
    q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS token FROM benchmark),
    scored AS (SELECT q.query_id, t.doc_id, sum(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s
               FROM q JOIN idf USING (token) JOIN tok t USING (token) JOIN dl ON dl.doc_id = t.doc_id, corpus GROUP BY 1, 2),
    kw AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM scored)
"""


@query("WITH" + _TOK + "SELECT token, df, round(idf, 9) AS idf FROM idf")
def keyword_terms(spark, sf_dir):
    return _keywords(spark, sf_dir).term_stats.select("token", "df", F.round("idf", 9).alias("idf"))


@query("WITH" + _TOK + "SELECT query_id, doc_id AS node_id, CAST(rank AS INTEGER) AS rank, round(s, 6) AS score FROM kw WHERE rank <= 8")
def keyword_top_k(spark, sf_dir):
    found = bm25.search(_keywords(spark, sf_dir), _questions(spark, sf_dir), 8, pad=False)
    return found.select("query_id", "node_id", "rank", F.round("raw_score", 6).alias("score"))


_VEC = """
    pairs AS (SELECT q.vec_id AS query_id, v.vec_id AS node_id, list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)) AS d
              FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0),
    near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, node_id) AS rank FROM pairs)
"""


def _near(spark, sf_dir, k):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding")
    return vector.search(rows, rows.where("node_id % 20 = 0").withColumnRenamed("node_id", "query_id"), k)


@query("WITH" + _VEC + "SELECT query_id, node_id, CAST(rank AS INTEGER) AS rank, round(-d, 6) + 0.0 AS score FROM near WHERE rank <= 8")
def vector_top_k(spark, sf_dir):
    return _near(spark, sf_dir, 8).select("query_id", "node_id", "rank", (F.round("raw_score", 6) + 0.0).alias("score"))  # never -0


def _hits(spark, sf_dir):
    """Two routes for the questions: keywords, and vectors of the same numbers."""
    keyword = bm25.search(_keywords(spark, sf_dir), _questions(spark, sf_dir), 8, pad=False).select("query_id", F.col("node_id").cast("bigint").alias("node_id"), "rank", "raw_score")
    near = stored(_near(spark, sf_dir, 8), "near")
    return ranking.union_hits([("content", False, near), ("summary", True, near.where("rank <= 3")), ("bm25", False, keyword)])


_HITS = f"""{_TOK}, {_VEC},
    hits AS (SELECT query_id, rank AS seq, node_id, 'content' AS route, rank, false AS w FROM near WHERE rank <= 8
             UNION ALL SELECT query_id, 1000000000 + rank, node_id, 'summary', rank, true FROM near WHERE rank <= 3
             UNION ALL SELECT query_id, 2000000000 + rank, doc_id, 'bm25', rank, false FROM kw WHERE rank <= 8),
    cand AS (SELECT h.query_id, h.node_id, sum(1.0 / (60 + rank)) + CASE WHEN count(DISTINCT route) > 1 THEN 0.05 * (count(DISTINCT route) - 1) ELSE 0 END
                    + CASE WHEN sum(w::INT) > 1 THEN 0.02 * (sum(w::INT) - 1) ELSE 0 END
                    + CASE max(quality) WHEN 1 THEN 0.03 WHEN 0 THEN -0.03 ELSE 0 END AS s, min(seq) AS first_seq
             FROM hits h LEFT JOIN labels l ON l.doc_id = h.node_id GROUP BY 1, 2),
    coarse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, first_seq, node_id) AS pos FROM cand)
"""


def _candidates(spark, sf_dir):
    marks = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("node_id")).agg(F.max("quality").alias("q"))
    marks = marks.select("node_id", F.when(F.col("q") == 1, "high").when(F.col("q") == 0, "low").alias("coherence"))
    found = ranking.with_metadata(ranking.aggregate_hits(_hits(spark, sf_dir)), marks).withColumn("is_neighbor", F.lit(False))
    return ranking.placed(ranking.score_candidates(found))


@query(f"WITH {_HITS} SELECT query_id, node_id, CAST(pos AS INTEGER) AS pos, round(s, 9) AS score FROM coarse WHERE pos <= 10")
def hybrid_fusion(spark, sf_dir):
    return ranking.top(_candidates(spark, sf_dir), 10).select("query_id", "node_id", "pos", F.round("fused_score", 9).alias("score"))


@query(
    f"""WITH {_HITS},
    sc AS (SELECT *, pos <= 10 AND node_id % 3 <> 0 AS scored, 0.2 * s + 0.8 * (node_id % 7) / 7.0 AS f FROM coarse)
    SELECT query_id, node_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY scored DESC, CASE WHEN scored THEN round(f, 12) END DESC NULLS LAST, pos) AS INTEGER) AS pos,
           round(CASE WHEN scored THEN f ELSE s END, 9) AS score FROM sc"""
)
def two_stage_rerank(spark, sf_dir):
    found = _candidates(spark, sf_dir)
    given = found.where("node_id % 3 <> 0").select("query_id", "node_id", ((F.col("node_id") % 7) / 7.0).alias("llm_score"))
    return ranking.model_rerank(found, given, 10).select("query_id", "node_id", "pos", F.round("final_score", 9).alias("score"))


def _turns(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("chunk_index"), "text").dropDuplicates(["doc_id", "chunk_index"])
    return t.withColumn("node_id", F.col("doc_id") * 1000 + F.col("chunk_index"))


@query("""
    WITH t AS (SELECT DISTINCT conv_id, turn, conv_id * 1000 + turn AS node_id FROM conversations),
    c AS (SELECT conv_id // 3 AS query_id, node_id, conv_id, turn, row_number() OVER (PARTITION BY conv_id // 3 ORDER BY node_id) AS pos FROM t WHERE turn % 2 = 0),
    n AS (SELECT c.query_id, t.node_id, c.node_id AS center_node_id, c.pos AS rank, CASE WHEN t.turn < c.turn THEN 0 ELSE 1 END AS side
          FROM c JOIN t ON t.conv_id = c.conv_id AND abs(t.turn - c.turn) = 1 WHERE c.pos <= 5),
    f AS (SELECT *, row_number() OVER (PARTITION BY query_id, node_id ORDER BY rank, side) AS r FROM n ANTI JOIN c USING (query_id, node_id))
    SELECT query_id, node_id, center_node_id, CAST(rank AS INTEGER) AS rank FROM f WHERE r = 1
""")
def neighbour_expansion(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    some = turns.where("chunk_index % 2 = 0").select(F.floor(F.col("doc_id") / 3).alias("query_id"), "node_id", F.lit(0.0).alias("s"), F.col("node_id").alias("first_seq"))
    return neighbours.expand(ranking.placed(some, "s"), turns, 1, 5)


@query("""
    WITH c AS (SELECT doc_id % 20 AS query_id, doc_id AS node_id, (doc_id * 37 % 101) / 101.0 AS s,
                      least(greatest(CASE WHEN doc_id % 3 = 0 THEN 0.3 ELSE 0 END + CASE WHEN lang = 'de' THEN 0.4 ELSE 0 END + CASE WHEN source = 'src1' THEN 0.2 ELSE 0 END
                            - CASE WHEN lang = 'es' THEN 0.3 ELSE 0 END - CASE WHEN doc_id % 5 = 0 THEN 0.2 ELSE 0 END, 0), 1) AS able FROM documents),
    m AS (SELECT *, s * 0.7 + able * 0.3 AS mixed FROM c),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(mixed, 12) DESC, node_id) AS seed_rank, max(mixed) OVER (PARTITION BY query_id) AS best FROM m)
    SELECT query_id, node_id, round(mixed, 9) AS seed_score, CAST(seed_rank AS INTEGER) AS seed_rank FROM r
    WHERE (seed_rank = 1 OR round(mixed, 12) >= round(best * 0.6, 12)) AND seed_rank <= 10
""")
def dependency_seeds(spark, sf_dir):
    return _seeds(spark, sf_dir).select("query_id", "node_id", F.round("seed_score", 9).alias("seed_score"), "seed_rank")


def _seeds(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    heading = F.when(F.col("lang") == "de", "配置").when(F.col("lang") == "es", "概述").otherwise("")
    able = scores.capability(F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0), heading, F.when(F.col("source") == "src1", "api"), F.when(F.col("doc_id") % 5 == 0, 0.5))
    mixed = (F.col("doc_id") * 37 % 101) / 101.0 * 0.7 + able * 0.3
    return dependency.pick_seeds(d.select((F.col("doc_id") % 20).alias("query_id"), F.col("doc_id").alias("node_id"), F.col("doc_id").alias("pos"), mixed.alias("seed_score")), 0.6, 10)


def _edges(spark, sf_dir):
    """Up to six edges a document, some to ids that don't exist, some to itself or twice to one target."""
    d = table(spark, sf_dir, "documents")
    n = d.select(F.max("doc_id").alias("top"))
    rows = d.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("edge_pos")).crossJoin(F.broadcast(n))
    return rows.select(F.lit("all").alias("doc_key"), F.col("doc_id").alias("source_id"), "edge_pos", ((F.col("doc_id") * 7 + F.col("edge_pos") * F.col("edge_pos") * 13) % (F.col("top") + 5)).alias("target_id"), ((F.col("doc_id") + F.col("edge_pos")) % 4 != 0).alias("required"), (((F.col("doc_id") * 31 + F.col("edge_pos") * 17) % 50) / 50.0).alias("confidence"))


_EDGE_SQL = """
    e AS (SELECT doc_id AS source_id, edge_pos, (doc_id * 7 + edge_pos * edge_pos * 13) % (top + 5) AS target_id, (doc_id + edge_pos) % 4 <> 0 AS required, ((doc_id * 31 + edge_pos * 17) % 50) / 50.0 AS confidence
          FROM documents, (SELECT max(doc_id) AS top FROM documents), (SELECT unnest(range(6)) AS edge_pos)),
    er AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY confidence DESC, edge_pos) AS edge_rank FROM e WHERE required AND confidence >= 0.7),
    rq AS (SELECT * FROM er WHERE edge_rank <= 5)
"""


@query(f"WITH {_EDGE_SQL} SELECT source_id, target_id, edge_pos, confidence, CAST(edge_rank AS INTEGER) AS edge_rank FROM rq")
def required_edges(spark, sf_dir):
    return dependency.required_edges(_edges(spark, sf_dir), 0.7, 5).select("source_id", "target_id", F.col("edge_pos").cast("bigint").alias("edge_pos"), "confidence", "edge_rank")


@query(f"""
    WITH {_EDGE_SQL}, seeds AS (SELECT doc_id // 20 AS query_id, doc_id AS node_id, row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) AS seed_rank FROM documents QUALIFY seed_rank <= 5),
    p AS (SELECT query_id, seed_rank, target_id, confidence, edge_rank, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, seed_rank, edge_rank) AS ord
          FROM seeds JOIN rq ON rq.source_id = seeds.node_id SEMI JOIN documents d ON d.doc_id = rq.target_id),
    f AS (SELECT p.*, min(ord) OVER (PARTITION BY query_id, target_id) AS first_ord, (query_id, target_id) IN (SELECT (query_id, node_id) FROM seeds) AS own FROM p),
    s AS (SELECT *, dense_rank() OVER (PARTITION BY query_id, own ORDER BY first_ord) AS slot, (SELECT count(*) FROM seeds z WHERE z.query_id = f.query_id) AS n FROM f)
    SELECT query_id, target_id, CAST(seed_rank AS INTEGER) AS seed_rank, confidence, CAST(ord AS INTEGER) AS ord, own OR slot <= 16 - n AS accepted FROM s
""")
def dependency_budget(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    flat = docs.select(F.floor(F.col("doc_id") / 20).alias("query_id"), F.col("doc_id").alias("node_id"), F.lit(1.0).alias("seed_score"), F.col("doc_id").alias("pos"))
    seeds = dependency.pick_seeds(flat, 0.0, 5)
    chosen = dependency.required_edges(_edges(spark, sf_dir), 0.7, 5)
    pending = seeds.join(chosen, seeds["node_id"] == chosen["source_id"]).join(docs.select(F.col("doc_id").alias("target_id")), "target_id", "left_semi")
    return dependency.admit(pending, seeds, 16).select("query_id", "target_id", "seed_rank", "confidence", "ord", "accepted")


@query(f"""
    WITH {_EDGE_SQL}, v AS (SELECT *, row_number() OVER (PARTITION BY source_id, target_id ORDER BY edge_pos) AS n FROM e SEMI JOIN documents d ON d.doc_id = e.target_id WHERE source_id <> target_id)
    SELECT source_id, edge_pos, target_id, confidence FROM v WHERE n = 1
""")
def edge_validation(spark, sf_dir):
    e = _edges(spark, sf_dir)
    body = F.to_json(F.struct(F.col("target_id").cast("string").alias("node_id"), F.lit("constraint").alias("relation_type"), "required", "confidence", F.lit("r").alias("reason")))
    raw = e.select("doc_key", F.col("source_id").cast("string").alias("source_id"), "edge_pos", normalise.edge(F.parse_json(body)).alias("edge"))
    nodes = table(spark, sf_dir, "documents").select(F.lit("all").alias("doc_key"), F.col("doc_id").cast("string").alias("node_id"))
    return dependency.valid_edges(raw, nodes).select(F.col("source_id").cast("bigint").alias("source_id"), F.col("edge_pos").cast("bigint").alias("edge_pos"), F.col("target_id").cast("bigint").alias("target_id"), "confidence")


@query("""
    WITH q AS (SELECT item_id AS query_id, CASE item_id % 4 WHEN 0 THEN '如何接入支付' WHEN 1 THEN '这个错误码表示什么' WHEN 2 THEN '上线前需要注意哪些错误码' ELSE text END AS t FROM benchmark)
    SELECT query_id, regexp_matches(t, '(怎么|如何)(接入|实现|配置|排查)|完整流程|哪些步骤|上线前|需要注意') AS use_dependencies,
           CASE WHEN regexp_matches(t, '(怎么|如何)(接入|实现|配置|排查)|完整流程|哪些步骤|上线前|需要注意|是什么|表示什么|返回哪些字段|有哪些字段|字段含义|错误码') THEN 1.0 ELSE 0.5 END AS confidence FROM q
""")
def route_rules(spark, sf_dir):
    q, n = table(spark, sf_dir, "benchmark"), F.col("item_id") % 4
    text = F.when(n == 0, "如何接入支付").when(n == 1, "这个错误码表示什么").when(n == 2, "上线前需要注意哪些错误码").otherwise(F.col("text"))
    return q.select(F.col("item_id").alias("query_id"), scores.route_decision(text).alias("d")).select("query_id", "d.use_dependencies", "d.confidence")


@query("""
    SELECT doc_id, substr(sha256(text), 1, 16) AS text_hash, substr(sha256(concat_ws('|', source, doc_id, substr(sha256(text), 1, 16))), 1, 24) AS node_id FROM documents
""")
def node_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ids.text_hash(F.col("text")).alias("text_hash"), ids.node_id(F.col("source"), F.col("doc_id"), F.col("text")).alias("node_id"))


def _states(spark, sf_dir):
    now = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_key"), F.sha2("text", 256).alias("content_hash"), "doc_id")
    before = now.where("doc_id % 7 <> 0").withColumn("content_hash", F.when(F.col("doc_id") % 11 == 0, "old").otherwise(F.col("content_hash")))
    return before, now.where("doc_id % 13 <> 0")


_DIFF = """
    p AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'old' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 7 <> 0),
    c AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 13 <> 0),
    d AS (SELECT CAST(doc_id AS VARCHAR) AS doc_key, CASE WHEN p.h IS NULL THEN 'added' WHEN c.h IS NULL THEN 'deleted' WHEN p.h <> c.h THEN 'changed' ELSE 'unchanged' END AS change FROM p FULL JOIN c USING (doc_id))
"""


@query(f"WITH {_DIFF} SELECT doc_key, change FROM d")
def document_diff(spark, sf_dir):
    return incremental.diff(*_states(spark, sf_dir))


@query(f"""
    WITH {_DIFF} SELECT doc_key, change, false AS rechunk_all, change IN ('added', 'changed') AS reannotate, change <> 'deleted' AS redependency, change IN ('added', 'changed') AS reembed FROM d
""")
def rebuild_decision(spark, sf_dir):
    found = incremental.decide(incremental.diff(*_states(spark, sf_dir)), incremental.Signals(dependency=True))
    return found.select("doc_key", "change", F.lit(False).alias("rechunk_all"), "reannotate", "redependency", "reembed")


@query("""
    WITH o AS (SELECT doc_id AS k, text AS v FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id AS k, 'new' AS v FROM documents WHERE doc_id % 4 = 0)
    SELECT * FROM (SELECT k, sha256(v) AS v FROM o ANTI JOIN n USING (k) WHERE k % 10 <> 1) UNION ALL SELECT k, sha256(v) FROM n
""")
def keyed_upsert(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    old, new = d.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("k"), F.col("text").alias("v")), d.where("doc_id % 4 = 0").select(F.col("doc_id").alias("k"), F.lit("new").alias("v"))
    gone = d.where("doc_id % 10 = 1").select(F.col("doc_id").alias("k"))
    return incremental.upsert(old, new, ["k"], gone).select("k", F.sha2("v", 256).alias("v"))


@query("""
    WITH r AS (SELECT doc_id % 50 AS k, doc_id, text FROM documents), m AS (SELECT k, max(doc_id) AS doc_id FROM r GROUP BY 1)
    SELECT k, doc_id, sha256(text) AS h FROM m JOIN r USING (k, doc_id)
""")
def last_record_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("k"), "doc_id", F.sha2("text", 256).alias("h"))
    return ids.last_wins(rows, "k", "doc_id")


@query("""
    SELECT conv_id AS doc_id, list(node_id ORDER BY turn) AS node_ids, count(*) AS n
    FROM (SELECT DISTINCT conv_id, turn, conv_id * 1000 + turn AS node_id FROM conversations) GROUP BY 1
""")
def chunks_by_document(spark, sf_dir):
    t = _turns(spark, sf_dir)
    return t.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "node_id"))), lambda x: x.node_id).alias("node_ids"), F.count("*").alias("n"))


@query("""
    SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN 'No indexed passage supports an answer.'
        ELSE concat('Most relevant passages:', chr(10), '- ', substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 160), ' [', item_id, ']') END AS answer FROM benchmark
""")
def extractive_answer(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    c = b.where("item_id % 3 <> 0").select(F.col("item_id").alias("query_id"), F.lit(1).alias("context_pos"), F.col("item_id").cast("string").alias("node_id"), F.lit("b").alias("doc_id"), F.lit("").alias("heading_path"), F.lit(None).cast("string").alias("summary"), "text")
    return answer.extractive(b.select(F.col("item_id").alias("query_id")), c).select("query_id", "answer")


@query()
def html_to_markdown(spark, sf_dir):
    return html.markdown_of(spread(table(spark, sf_dir, "pages")), "html", ["page_id", "url"])


from . import coverage  # noqa: E402, F401  (registers the rest)
