import itertools
import zlib
from collections import Counter

import numpy as np
import regex
from pyspark.sql import functions as F

from tessellum.llm import toxicity
from tessellum.llm.queries import QUERIES

CLEAN = "the weather is fine and the garden has many flowers and trees today".split()


def corpus(n=400, bad="idiot"):
    rng = np.random.default_rng(2)
    texts, marks = [], []
    for i in range(n):
        words = rng.choice(CLEAN, 20).tolist()
        if i % 4 == 0:
            words[int(rng.integers(20))] = bad
        texts.append(" ".join(words))
        marks.append(int(i % 4 == 0))
    return texts, marks


def test_restores_disguised_words():
    model = toxicity.fit(*corpus())
    for disguised in ("id1ot", "!d1ot", "1d10t", "i.d.i.o.t", "i-d-i-o-t", "idiiiiiot", "idioooot"):
        assert "idiot" in model.restore(disguised), disguised
    assert model.restore("garden") == ["garden"] and model.restore("2024") == [] and model.restore("--") == []
    assert model.join(list("theidiot")) == ["the", "idiot"]


def test_scores_disguised_texts_like_plain_ones():
    model = toxicity.fit(*corpus())
    score = toxicity.Scorer(model).score
    assert score("the garden has an idiot today") > 0.9
    for disguised in ("1d10t", "i d i o t", "i.d.i.o.t", "IDIOOOT"):
        assert score(f"the garden has {disguised} today") > 0.9, disguised
    assert score("the garden has many flowers today") < 0.1


def test_signs_alone_spell_known_words_only():
    model = toxicity.fit(*corpus(bad="tosse"))
    assert model.restore("70553") == ["tosse"] and model.restore("1984") == [] and model.restore("70") == []
    assert toxicity.Scorer(model).score("the garden has 70553 today") > 0.9


def test_viterbi_equals_all_paths():
    model = toxicity.CharModel(toxicity._trigrams({"idiot": 5, "fool": 3, "list": 7, "tall": 2, "soil": 4}), {})
    full = lambda w: sum(model.log(f"^^{w}$"[i - 2 : i], f"^^{w}$"[i]) for i in range(2, len(w) + 3))
    for lattice in (["il", "d", "il", "o", "t"], ["ft", "o", ["o", "oo"], "il"], [["a", "aa"], "il", ["s", "ss"], "t"], ["x", "yz", "i"]):
        paths = ["".join(p) for p in itertools.product(*lattice)]
        best = model.decode([list(x) for x in lattice])
        assert best in paths and abs(full(best) - max(map(full, paths))) < 1e-9


def test_long_runs_of_letters_set_apart():
    model = toxicity.fit(*corpus())
    words = model.join(list("theidiot" * 200))
    assert words == ["the", "idiot"] * 200


def test_trigrams_of_all_texts(spark, documents, rows, messy):
    words = Counter(w for _, t in rows for w in regex.findall(r"\p{L}+", (t or "").lower()))
    want = Counter()
    for w, n in words.items():
        p = f"^^{w}$"
        for i in range(2, len(p)):
            want[p[i - 2 : i + 1]] += n
    assert toxicity.trigrams(documents, 0.0) == want
    most = toxicity.trigrams(documents, 1e-3)
    assert most == {k: n for k, n in want.items() if n >= 1e-3 * sum(want.values())} and len(most) <= 1000
    assert toxicity.trigrams(messy) and toxicity.trigrams(messy.limit(0)) == {}


def test_empty_and_untrained():
    model = toxicity.fit(*corpus())
    score = toxicity.Scorer(model).score
    assert 0 <= score(None) == score("") == score("   ") < 0.5
    assert toxicity.Scorer(toxicity.fit(["a b"], [0])).score("a") == 0.0
    assert toxicity.Scorer(toxicity.fit([], [])).score("a") == 0.0


def test_edge_cases(spark, messy):
    model = toxicity.fit(*corpus())
    got = toxicity.score(messy, model).collect()
    assert len(got) == messy.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert toxicity.score(messy.limit(0), model).collect() == []
    labels = spark.createDataFrame([(1, 0, 1), (2, 0, None), (None, 0, 1), (1, 0, 1), (3, 0, 0)], "doc_id bigint, quality int, toxic int")
    texts, marks = toxicity.sample(messy, labels, bound=100)
    assert texts == ["one two three four five six", ""] and marks == [1, 0]
    assert toxicity.sample(messy, labels.limit(0), bound=100) == ([], [])


def test_learns_from_every_labelled_row_and_every_word(spark):
    """More labelled rows than the 8,000 that a sample once held; unlabelled texts count for the words."""
    rng = np.random.default_rng(5)
    data = [(i, " ".join([*rng.choice(CLEAN, 4), *([f"bad{'abcdefghij'[i % 10]}word"] if i % 6 == 0 else [])]), int(i % 6 == 0)) for i in range(9000)]
    extra = [(10_000 + i, "unlabelled quokkas") for i in range(5)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + extra, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id bigint, toxic int")
    model = toxicity.learn(docs, labels)
    words = Counter(w for _, t in [(i, t) for i, t, _ in data] + extra for w in regex.findall(r"\p{L}+", t))
    assert len(model.chars.words.keys) == len(words) and "quokkas" in model.chars.words
    assert all(abs(model.chars.words.get(w) - np.log(n / (sum(words.values()) + 1))) < 1e-9 for w, n in words.items())
    fifth = {r["doc_id"]: r["f"] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(5)).alias("f")).collect()}
    rows = [(set(t.split()), y) for i, t, y in data if fifth[i] != 4]
    rate = sum(y for _, y in rows) / len(rows)
    for c in "acegi":
        k = sum(f"bad{c}word" in t for t, _ in rows)
        if k:
            p = (k + toxicity.SHRINK * rate) / (k + toxicity.SHRINK)
            assert abs(model.evidence.get(f"bad{c}word$") - np.log(p / (1 - p)) + np.log(rate / (1 - rate))) < 1e-9
    again = toxicity.learn(docs.repartition(7), labels.repartition(3))
    assert again.weights.tolist() == model.weights.tolist() and again.evidence.keys == model.evidence.keys
    got = toxicity.score(docs, model).join(labels, "doc_id").collect()
    assert all(r["predicted"] == r["toxic"] for r in got)
    assert toxicity.learn(docs, labels.limit(0)).weights.size == 0 == toxicity.learn(docs.limit(0), labels).weights.size


def test_what_words_share_is_looked_up_once():
    """Words with the same beginning ask for its evidence once, and frequent words outlive a full cache; the scores are those of a scorer that knows nothing yet."""

    class Asked(dict):
        n = 0

        def get(self, *a):
            Asked.n += 1
            return super().get(*a)

    model = toxicity.fit(*corpus())
    model.evidence = Asked(model.evidence)
    endings = ["".join(p) for p in itertools.product("abcdefghij", repeat=3)]
    toxicity.Scorer(model).score(" ".join(f"gardening{e}" for e in endings))
    assert Asked.n <= len(endings) + len(toxicity.PREFIXES)  # each word as a whole, the beginnings once
    scorer = toxicity.Scorer(model, memo=200)
    texts = [" ".join([*CLEAN, "id1ot", "idiot,", "g!", "x", "***", *(f"rarely{e}" for e in endings[i : i + 5])]) for i in range(0, 1000, 5)]
    Asked.n = 0
    got = [scorer.score(t) for t in texts]
    assert Asked.n < 2 * len(endings) + 200
    assert got == [toxicity.Scorer(model).score(t) for t in texts] and min(got) > 0.9


def test_evidence_of_a_chunk_is_the_greatest_of_its_units():
    model = toxicity.fit(*corpus())
    scorer = toxicity.Scorer(model)
    for chunk in ("idiot", "idiots", "idiotic", "idiotically", "idi", "garden", "«idiot»", "idiot!", "id1ot", "!d1ot", "idiooot", "idiot-garden", "x", "1", "ß", "...", "70553", "漢字", "aaa", "\ud800"):
        words = model.restore(chunk)
        want = max((model.evidence.get(u, 0.0) for w in words for u in [w + "$", *(w[:k] for k in toxicity.PREFIXES if len(w) >= k)]), default=0.0)
        assert abs(scorer.known[chunk]) == max(want, 0.0), chunk
        assert np.signbit(scorer.known[chunk]) == (chunk in ("x", "1", "ß")), chunk


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op7_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    hit = sum(r["predicted"] == 1 == r["toxic"] for r in held)
    assert hit >= 0.85 * sum(r["toxic"] == 1 for r in held) and hit >= 0.95 * sum(r["predicted"] == 1 for r in held)
