import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessellum.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    return bpe.codec(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def library(own):
    return tiktoken.Encoding("library", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_rejects_strangers(own):
    assert own.hash.n == len(own.ranks) and None not in own.hash.keys
    assert all(own.hash.get(t) == i for t, i in own.ranks.items())
    assert own.hash.get(b"\x00not in the vocabulary") is None


def test_equals_library_on_documents(own, library, rows):
    for _, text in rows:
        ids = own.encode(text)
        assert ids == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\xa0'sdl,.19aeé漢😀 \x1c\x85"), st.characters(codec="utf-8"))))
def test_equals_library_on_any_text(own, library, text):
    ids = own.encode(text)
    assert ids == library.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


def test_merges_long_words(own, library):
    for word in ("a" * 5000, "ab" * 3000, "xyzzy" * 999):
        assert own.encode(word) == library.encode_ordinary(word)


def test_query_digests_and_edge_cases(spark, messy, library):
    got = bpe.encode(messy, PATH, P.PATTERN, digests=True).collect()
    assert len(got) == messy.count()
    texts = {}
    for r in messy.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    for doc in texts:
        want = sorted((len(x := library.encode_ordinary(t)), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for t in texts[doc])
        assert sorted(tuple(r)[1:] for r in got if r["doc_id"] == doc) == want
    assert bpe.encode(messy.limit(0), PATH, P.PATTERN).collect() == []


def test_ids_and_bytes(spark, messy, library):
    for r in bpe.encode(messy, PATH, P.PATTERN, keep=["text"]).collect():
        assert list(r["ids"]) == library.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
