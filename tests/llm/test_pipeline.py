import hashlib

import brute
import corpus_pipeline
import public_tokenizers as P
import tiktoken

from tessellum.llm import bpe, decontam, langid, queries


def test_stages_have_the_contract(spark, sf_dir, documents):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, documents, sf_dir).dtypes == documents.dtypes


def test_equals_brute_force(spark, sf_dir, documents):
    docs = [tuple(r) for r in documents.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    model = langid.Scorer(langid.fit(langid.sample(documents, per_lang=400)))
    kept = [d for d in docs if (p := model.predict(d[1]))[0] != "und" and p[1] > 0.5]
    lines = brute.line_dedup([d[:2] for d in kept])
    kept = [(i, lines[i][0], *rest) for i, t, *rest in kept if not lines[i][2] or lines[i][0]]
    groups, _ = brute.near_groups([d[:2] for d in kept], 5)
    kept = [d for d in kept if groups[d[0]] == d[0]]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaks = {d for d, _ in brute.leaks([d[:2] for d in kept], items, 0.1, lambda p, t: decontam._ends(p, t)[0])}
    kept = [d for d in kept if d[0] not in leaks]
    library = tiktoken.Encoding("library", pat_str=P.PATTERN, mergeable_ranks=bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).ranks, special_tokens={})
    want = []
    for i, text, lang, source, _ in kept:
        ids = library.encode_ordinary(text)
        want.append((i, lang, source, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert leaks and len(want) < len(docs)


def test_messy_rows_pass_every_stage(spark, sf_dir, messy):
    for docs in (messy, messy.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            n = docs.count()
            docs = stage(spark, docs, sf_dir)
            assert docs.count() <= n


def test_every_operator_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11)) and set(queries.ORACLES) <= set(queries.QUERIES)
