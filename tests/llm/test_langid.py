from tessellum.llm import langid
from tessellum.llm._common import crc_mod
from tessellum.llm.queries import QUERIES

TEXTS = {
    "de": ["der hund und die katze sind nicht hier", "das haus und der garten sind schön"],
    "en": ["the dog and the cat are not here", "the house and the garden are lovely"],
}


def test_known_words_come_first_and_unknown_ones_back_off():
    model = langid.fit(TEXTS)
    score = langid.Scorer(model).predict
    assert score("the cat")[0] == "en" and score("Die Katze!")[0] == "de"
    assert "katzengarten" not in model.words and score("katzengarten")[0] == "de"  # by its n-grams
    assert "und" in model.words
    assert 0.5 <= score("garten")[1] <= 1


def test_longer_grams_cost_less_than_shorter_ones():
    model = langid.fit({"a": ["abcdef abcdef"], "b": ["zyxwv zyxwv"]})
    assert model.word("abcdeq")[0] > model.word("abqqqq")[0] > model.word("qqqqqq")[0]


def test_no_letters_and_no_model():
    score = langid.Scorer(langid.fit(TEXTS)).predict
    for text in (None, "", "  ", "123 456 !?", "\u0301\u0302", "12\u0301 \u0300"):
        assert score(text) == ("und", 0.0)
    assert langid.Scorer(langid.fit({})).predict("the cat") == ("und", 0.0)


def test_tie_goes_to_the_first_language():
    assert langid.Scorer(langid.fit({"b": ["same words"], "a": ["same words"]})).predict("same")[0] == "a"


def test_edge_cases(spark, messy):
    model = langid.fit(langid.sample(messy, per_lang=100))
    got = langid.predict(messy, model, keep=["source"]).collect()
    assert len(got) == messy.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (3, 4, 5)} == {"und"}
    assert langid.predict(messy.limit(0), model).collect() == []
    assert langid.sample(messy.where("lang is null"), per_lang=5) == {}


def test_training_never_sees_held_out_rows(spark, documents):
    docs = documents.withColumn("rest", crc_mod("doc_id", 4))
    model = langid.fit(langid.sample(docs.where("rest <> 2"), per_lang=400))
    scorer = langid.Scorer(model)
    held = docs.where("rest = 2 and lang is not null").select("text", "lang").collect()
    assert len(held) > 20 and sum(scorer.predict(r["text"])[0] == r["lang"] for r in held) >= 0.9 * len(held)


def test_query(spark, sf_dir, documents):
    import zlib

    got = {r["doc_id"]: r for r in QUERIES["op4_language_id"](spark, sf_dir).collect()}
    assert len(got) == documents.count()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    truth = {r["doc_id"]: r["lang"] for r in documents.select("doc_id", "lang").collect()}
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
