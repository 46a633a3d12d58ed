from collections import Counter, defaultdict
from concurrent.futures import ThreadPoolExecutor

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tessellum.llm import rollup
from tessellum.llm._common import shared_dir
from tessellum.llm.queries import QUERIES

ROWS = "source string, lang string, tokenizer_version string, n_tokens bigint"


@pytest.fixture
def root(spark):
    return shared_dir(spark, "rollup-test")


def state(spark, root):
    return {(r["source"], r["lang"], r["tokenizer_version"]): (r["n_docs"], r["n_tokens"]) for r in rollup.totals(spark, root).collect()}


def test_signed_changes_and_repeated_batches(spark, root):
    load = spark.createDataFrame([("a", "en", "v1", 10), ("a", "en", "v1", 5), ("b", None, "v1", None), (None, "de", "v2", 7)], ROWS)
    assert rollup.commit(spark, root, "1", rollup.inserted(load))
    assert not rollup.commit(spark, root, "1", rollup.inserted(load))
    first = {("a", "en", "v1"): (2, 15), ("b", None, "v1"): (1, 0), (None, "de", "v2"): (1, 7)}
    assert state(spark, root) == first
    moved = spark.createDataFrame([("a", "fr", "v2", 6, "a", "en", "v1", 5)], f"{ROWS}, old_source string, old_lang string, old_tokenizer_version string, old_n_tokens bigint")
    assert rollup.commit(spark, root, "2", rollup.revised(moved))
    assert rollup.commit(spark, root, "3", rollup.deleted(load.where("source = 'b'")))
    want = {("a", "en", "v1"): (1, 10), ("a", "fr", "v2"): (1, 6), (None, "de", "v2"): (1, 7)}
    assert state(spark, root) == want
    rollup.compact(spark, root)
    assert state(spark, root) == want
    for batch in ("1", "2", "3"):
        assert not rollup.commit(spark, root, batch, rollup.inserted(load))
    rollup.commit(spark, root, "4", rollup.inserted(load.where("source = 'b'")))
    rollup.compact(spark, root)
    assert state(spark, root) == want | {("b", None, "v1"): (1, 0)}
    assert not rollup.commit(spark, root, "4", rollup.inserted(load))


def test_batch_that_broke_off_is_applied_once(spark, root):
    load = spark.createDataFrame([("a", "en", "v1", 10)], ROWS)
    rollup.inserted(load).write.parquet(f"{root}/drafts/x/1")
    assert state(spark, root) == {}
    assert rollup.commit(spark, root, "1", rollup.inserted(load))
    assert state(spark, root) == {("a", "en", "v1"): (1, 10)}


def test_two_drivers_send_one_batch(spark, root):
    load = spark.createDataFrame([("a", "en", "v1", 10)], ROWS)
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda _: rollup.commit(spark, root, "1", rollup.inserted(load)), range(4)))
    assert sum(done) == 1 and state(spark, root) == {("a", "en", "v1"): (1, 10)}


def test_empty(spark, root):
    assert state(spark, root) == {}
    assert rollup.commit(spark, root, "1", rollup.inserted(spark.createDataFrame([], ROWS)))
    assert state(spark, root) == {}
    assert not rollup.commit(spark, root, "1", rollup.inserted(spark.createDataFrame([], ROWS)))


def library():
    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def test_counts_of_messy_texts(spark, messy):
    files = {"v1": P.path("word_bpe_49k.json"), "v2": P.path("word_bpe_49k.json")}
    lib, got = library(), rollup.count(messy, files).collect()
    want = Counter((r["doc_id"], r["source"], r["lang"], v, len(lib.encode(r["text"] or "", add_special_tokens=False).ids)) for r in messy.collect() for v in files)
    assert Counter(tuple(r) for r in got) == want
    assert rollup.count(messy.limit(0), files).collect() == []


def test_query_equals_counts_by_the_library(spark, sf_dir, documents):
    lib, want, seen = library(), defaultdict(lambda: [0, 0]), set()
    gone = 0
    for r in documents.orderBy("doc_id").collect():
        n = len(lib.encode(r["text"] or "", add_special_tokens=False).ids)
        if (r["text"] or "") in seen:
            gone += n
            continue
        seen.add(r["text"] or "")
        of = want[(r["source"], r["lang"], "word_bpe_49k-1")]
        of[0] += 1
        of[1] += n
    got = {(r["source"], r["lang"], r["tokenizer_version"]): [r["n_docs"], r["n_tokens"]] for r in QUERIES["op5_token_rollup"](spark, sf_dir).collect()}
    assert got == dict(want) and gone > 0
