import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessellum.llm import wavelet
from tessellum.llm.wavelet import WaveletMatrix

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=300), st.integers(6, 17))
def test_rank_select_access(values, bits):
    wm = WaveletMatrix.from_bytes(WaveletMatrix.build(np.array(values, np.int64), bits).to_bytes())
    assert wm.decode().tolist() == values
    assert [wm.access(i) for i in range(len(values))] == values
    for v in set(values) | {41}:
        places = [i for i, x in enumerate(values) if x == v]
        assert wm.count(v) == len(places)
        assert [wm.select(v, k) for k in range(len(places))] == places
        assert wm.count(v, len(values) // 3, len(values) // 2) == sum(len(values) // 3 <= i < len(values) // 2 for i in places)
        with pytest.raises(IndexError):
            wm.select(v, len(places))
    with pytest.raises(IndexError):
        wm.access(len(values))


def test_large_shard_as_a_file(tmp_path):
    values = np.random.default_rng(1).zipf(1.3, 50_000) % 49_408
    WaveletMatrix.build(values, 16, [5, 6], [20_000, 30_000]).save(f"{tmp_path}/shard.wm")
    wm = WaveletMatrix.load(f"{tmp_path}/shard.wm")
    assert np.array_equal(wm.decode(), values) and wm.doc_ids.tolist() == [5, 6] and wm.lengths.tolist() == [20_000, 30_000]
    assert wm.count(1) == (values == 1).sum() and wm.select(1, 100) == np.flatnonzero(values == 1)[100]
    assert wm.count(1 << 20) == 0
    with pytest.raises(ValueError):
        WaveletMatrix.from_bytes(b"something else")


def expected(library, docs):
    """Rows by doc_id, then text; nulls first."""
    out, at = [], 0
    for doc, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, (d[1] or "").encode())):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def found(spark, docs, **options):
    key = lambda r: r[1]
    return sorted((tuple(r)[:4] for r in wavelet.read_shards(spark, wavelet.write_shards(docs, PATH, 2, **options)).collect()), key=key)


def test_equals_library_on_documents(spark, documents, rows, library):
    assert found(spark, documents) == expected(library, rows)
    assert found(spark, documents, shard_tokens=1000) == expected(library, rows)


def test_edge_cases(spark, messy, library):
    assert found(spark, messy) == expected(library, [(r["doc_id"], r["text"]) for r in messy.select("doc_id", "text").collect()])
    assert found(spark, messy.limit(0)) == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\xa0'.,-AZaé漢😀 \x1cİßǅﬁ́<|>"), st.characters(codec="utf-8"))))
def test_encoder_equals_library_on_any_text(library, text):
    enc = wavelet.encoder(PATH)
    assert np.frombuffer(enc.encode([text])[0], enc.kind).tolist() == library.encode(text, add_special_tokens=False).ids


def test_encoder_special_strings(library):
    enc = wavelet.encoder(PATH)
    for text in ("a <|endoftext|> b", "<|startoftext|>", "x<|endoftext|>y"):
        assert np.frombuffer(enc.encode([text])[0], enc.kind).tolist() == library.encode(text, add_special_tokens=False).ids


def test_build_and_decode_cost_less_than_masks():
    """Of bits like a coin's, a level by places takes well below the time of one by masks (medians of 5 runs in turns)."""
    ids = np.random.default_rng(3).integers(0, 1 << 16, 400_000).astype(np.uint16)

    def by_masks():
        seq = ids
        for level in range(15, -1, -1):
            ones = (seq & np.uint16(1 << level)) != 0
            seq = np.concatenate([seq[~ones], seq[ones]])
        return seq

    def timed(f):
        began = time.process_time()
        f()
        return time.process_time() - began

    whole = WaveletMatrix.build(ids, 16)
    assert (whole.decode() == ids).all()
    took = [(timed(by_masks), timed(lambda: WaveletMatrix.build(ids, 16)), timed(whole.decode)) for _ in range(5)]
    masks, build, decode = np.median(took, axis=0)
    assert build < 0.75 * masks and decode < 0.75 * masks
