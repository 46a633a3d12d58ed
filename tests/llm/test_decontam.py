import random

import brute

from tessellum.llm import decontam
from tessellum.llm.queries import QUERIES

SCHEMA = "item_id bigint, text string"


def words(rng, n):
    return [rng.choice(("ba", "ke", "lo", "mi", "nu", "ra", "so", "ti")) + rng.choice(("n", "r", "s", "t", "l")) + rng.choice(("a", "e", "i", "o", "u")) for _ in range(n)]


def edited(rng, text, share):
    """Random edits of characters, ``share`` of the length."""
    out = list(text)
    for _ in range(int(len(text) * share)):
        i = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[i] = rng.choice("abcdefgh")
        elif kind == 1:
            out.insert(i, rng.choice("abcdefgh "))
        else:
            del out[i]
    return "".join(out)


def test_nearest_substring():
    rng = random.Random(3)
    for _ in range(300):
        p, t = ("".join(rng.choices("abc ", k=rng.randrange(1, n))) for n in (12, 40))
        edits, start, end = decontam.nearest(p, t)
        assert edits == brute.substring_edits(p, t)
        assert decontam._ends(p, t[start:end])[0] == edits and 0 <= start <= end <= len(t)


def test_recall_of_edited_items():
    rng = random.Random(7)
    items = [(i, " ".join(words(rng, rng.randrange(12, 60)))) for i in range(60)]
    index = decontam.Index(items, 0.1)
    for share, least in ((0.0, 1.0), (0.04, 0.99), (0.09, 0.95)):
        hit = 0
        for i, text in items * 5:
            doc = " ".join([*words(rng, 40), edited(rng, text, share), *words(rng, 40)])
            hit += i in {m[0] for m in index.search([doc])[0]}
        assert hit >= least * 5 * len(items), (share, hit)


def test_recall_at_all_edits_of_short_items_and_common_pairs():
    rng = random.Random(11)
    common = words(rng, 6)
    plain = [(i, " ".join(words(rng, rng.randrange(4, 30)))) for i in range(60)]
    pairs = [(i, " ".join(rng.choice(common) for _ in range(rng.randrange(12, 40)))) for i in range(200)]
    for items in (plain, pairs):
        index = decontam.Index(items, 0.1)
        for item, text in items:
            doc = " ".join([*words(rng, 20), edited(rng, text, 0.1), *words(rng, 20)])
            want = {i for i, t in items if decontam._ends(t, doc)[0] <= int(len(t) * 0.1)}
            assert item in want and {m[0] for m in index.search([doc])[0]} == want


def test_results_do_not_depend_on_the_size_of_the_benchmark():
    rng = random.Random(12)
    for _ in range(40):
        text = " ".join(words(rng, 20))
        doc = edited(rng, text, 0.1)
        more = [(i, text) for i in range(2, 40)]
        alone, among = ([m for m in decontam.Index(items, 0.1).search([doc])[0] if m[0] == 1] for items in ([(1, text)], [(1, text), *more]))
        assert alone == among != []


def test_equals_brute_force(spark, sf_dir, documents, rows):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in benchmark.select("item_id", "text").collect()]
    want = brute.leaks(rows, items, 0.1, lambda p, t: decontam._ends(p, t)[0])
    found = QUERIES["op10_benchmark_leaks"](spark, sf_dir).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want and want
    texts, item = dict(rows), dict(items)
    for r in found:
        passage = " ".join(texts[r["doc_id"]][r["start"] : r["end"]].lower().split())
        assert r["edits"] <= len(item[r["item_id"]]) * 0.1 and brute.substring_edits(" ".join(item[r["item_id"]].lower().split()), passage) <= r["edits"] + 1
    clean = {r["doc_id"] for r in decontam.without_matches(documents, benchmark).collect()}
    assert clean == set(texts) - {d for d, _ in want}


def test_short_items_must_occur_exactly():
    index = decontam.Index([(1, "alpha"), (2, "beta gamma"), (3, "one two three")], 0.1)
    found = lambda t: {m[0] for m in index.search([t])[0]}
    assert found("so Alpha is") == {1} and found("alphas") == set() and found("beta  GAMMA") == {2} and found("beta gammas") == set()
    assert found("x one two three y") == {3} and found("one two tree") == set()


def test_scripts_without_spaces():
    long = "机器学习模型在大规模语料上的训练需要大量的计算资源和数据"
    index = decontam.Index([(1, long), (2, "计算资源")], 0.1)
    found = lambda t: {m[0] for m in index.search([t])[0]}
    assert found(f"前言{long}后记") == {1, 2} and found(f"前言{long.replace('语料', '语库')}后记") == {1, 2} and found("需要计算资源的") == {2} and found("别的文字") == set()


def test_every_place_is_reported():
    text = "the quick brown fox jumps over the lazy dog and runs away"
    found = decontam.Index([(5, text)], 0.1).search([f"a b {text} c d {text.upper()} e"])[0]
    assert [(m[0], m[1], m[3]) for m in found] == [(5, 2, 0), (5, 16, 0)]


def test_edge_cases(spark, messy):
    items = spark.createDataFrame([(1, "one two three four five six", 0), (1, "one two three four five six", 0), (2, None, 0), (3, "", 0), (4, "  ", 0), (None, "x", 0), (5, "line 4000 of a very long text with words w4000 x28000 y9", 0)], f"{SCHEMA}, doc_id int")
    found = [(r["doc_id"], r["item_id"], r["start"], r["end"], r["edits"]) for r in decontam.matches(messy, items).collect()]
    assert {f[:2] for f in found} >= {(1, 1), (2, 1), (None, 1), (6, 5)} and all(f[1] in (1, 5) for f in found)
    kept = decontam.without_matches(messy, items)
    assert kept.columns == messy.columns
    assert sorted((str(r["doc_id"]) for r in kept.collect())) == sorted(["3", "4", "5", "None", "7", "7", "7", "8"])
    assert decontam.matches(messy.limit(0), items).collect() == [] and decontam.matches(messy, items.limit(0)).collect() == []
    assert decontam.without_matches(messy, items.limit(0)).count() == messy.count()


def test_benchmark_beyond_one_broadcast(spark):
    rng = random.Random(9)
    items = [(i, " ".join(words(rng, 30))) for i in range(20)]
    rows = spark.createDataFrame(items, SCHEMA)
    assert [len(g) for g in decontam.groups(rows, bound=400)] != [20] and sum(len(g) for g in decontam.groups(rows, bound=400)) == 20
    assert list(decontam.groups(rows, bound=1)) == [[i] for i in sorted(items)]
