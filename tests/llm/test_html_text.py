import re

import pyarrow.parquet as pq
import pytest

from tessellum.llm import html_text
from tessellum.llm.queries import QUERIES

LONG = "This is a paragraph of the article with quite a number of words, so that its ratio of text to tags is high"


def page(body, head="<title>T</title><script>var x = '<p>no</p>';</script><style>p{}</style>"):
    return f"<!doctype html><html><head>{head}</head><body>{body}</body></html>"


def test_article_alone_is_left():
    html = page(
        '<header><a href="/">Home</a></header><nav><ul><li><a href=a>A</a><li><a href=b>B</a></ul></nav><div class="cookie-notice">We use cookies</div>'
        f"<article><h1>Title &amp; more</h1><p>{LONG} 1.</p><p>Short.</p><div class='advert'>Buy now</div><p>{LONG}\n   2&nbsp;&#233;.</p><form><input name=q><button>Go</button></form></article>"
        f'<aside class="sidebar">{LONG}</aside><section id="comments"><p>{LONG}</p></section><footer>Imprint {LONG}</footer>'
    )
    assert html_text.extract(html) == f"Title & more\n\n{LONG} 1.\n\nShort.\n\n{LONG} 2 é."


def test_page_without_article_element():
    html = page("<ul class=menu>" + "<li><a href=x>Some entry of the menu</a></li>" * 9 + f"</ul><div><h2>Head</h2><p>{LONG} 1.</p><p>{LONG} 2.</p><p>{LONG} 3.</p></div><div class=footer>small print</div>")
    assert html_text.extract(html) == "Head\n\n" + "\n\n".join(f"{LONG} {i}." for i in (1, 2, 3))


def test_thresholded_lines_choose_among_articles():
    second = f"<article><h2>Second</h2><p>{LONG} 9.</p></article>"
    first = "<article>" + "".join(f"<p>{LONG} {i}.</p>" for i in range(6)) + "</article>"
    got = html_text.extract(page(first + second))
    assert got == "\n\n".join([*(f"{LONG} {i}." for i in range(6)), "Second", f"{LONG} 9."])


def test_link_lists_in_an_article_are_left_out():
    links = "<h3>More</h3><ul>" + "<li><a href=x>Some entry of a list of links</a></li>" * 5 + "</ul>"
    assert html_text.extract(page(f"<article><h1>Head</h1><p>{LONG} 1.</p>{links}<p>{LONG} 2.</p></article>")) == f"Head\n\n{LONG} 1.\n\n{LONG} 2."


def test_a_linked_name_below_the_title_does_not_cut_it_off():
    assert html_text.extract(page(f"<article><h1>Head</h1><p><a href=x>A Name</a></p><p>{LONG}</p></article>")) == f"Head\n\n{LONG}"


def test_teasers_do_not_replace_the_content_outside_them():
    teasers = "".join(f"<article><h3>Teaser {i}</h3><p>Read on.</p></article>" for i in range(3))
    got = html_text.extract(page("<div>" + "".join(f"<p>{LONG} {i}.</p>" for i in range(6)) + f"</div><div>{teasers}</div>"))
    assert all(f"{LONG} {i}." in got for i in range(6))


@pytest.mark.parametrize("wrap", ["<div class='content-sidebar-wrap'>%s</div>", "<div class='layout with-sidebar'>%s</div>", "<div id='search-results'>%s</div>", "<section class='legal'>%s</section>", "<form action=x>%s</form>", "<form><div class='with-sidebar'>%s</div></form>"])
def test_a_box_around_the_page_does_not_exclude_it(wrap):
    text = f"<p>{LONG} 1.</p><p>{LONG} 2.</p>"
    advert = "<div class='advert'>Buy now</div>"
    for body in (f"<article>{text}{advert}</article>", text + advert):
        assert html_text.extract(page(wrap % body)) == f"{LONG} 1.\n\n{LONG} 2."


def test_many_comments_beside_an_article_stay_excluded():
    comments = "<section id='comments'>" + f"<article><p>{LONG}</p></article>" * 9 + "</section>"
    assert html_text.extract(page(f"<article><p>{LONG} 1.</p></article>{comments}")) == f"{LONG} 1."


def test_boxes_count_when_nothing_else_is_left():
    boxes = "".join(f"<div class='notice'><p>{LONG} {i}.</p></div>" for i in range(3))
    assert html_text.extract(page(boxes)) == "\n\n".join(f"{LONG} {i}." for i in range(3))


def test_a_box_within_a_line():
    assert html_text.extract(page(f"<article><p>{LONG} <span class='ad'>Buy now</span> 1.</p><p><span class='ad'>Buy now</span> {LONG} 2.</p></article>")) == f"{LONG} 1.\n\n{LONG} 2."


def test_inline_markup_and_entities():
    assert html_text.extract(page(f"<main><p>{LONG} <b>bo</b>ld<br>next &lt;tag&gt; &euro;</p></main>")) == f"{LONG} bold next <tag> €"


def test_hidden_text_is_left_out():
    assert html_text.extract(page(f"<main><p>{LONG}</p><p hidden>secret</p><p style='display: none'>secret</p><p aria-hidden=true>secret</p><noscript>secret</noscript></main>")) == LONG


@pytest.mark.parametrize("html", [None, "", " ", "<html></html>", "<script>x</script>", "<!-- only -->", "<p", "</p></div>"])
def test_nothing_to_extract(html):
    assert html_text.extract(html) == ""


def test_broken_markup_is_read_as_far_as_it_goes():
    assert html_text.extract(f"<html><body><article><p>{LONG}<p>{LONG} two</div></article>") == f"{LONG}\n\n{LONG} two"
    deep = "<div>" * 5000 + LONG + "</div>" * 5000
    assert html_text.extract(page(deep)) == LONG


def test_smoothing_and_threshold():
    assert html_text.smooth([3.0] * 9) == pytest.approx([3.0] * 9)
    assert html_text.threshold([1.0, 1.2, 0.9, 30.0, 31.0]) == pytest.approx((3.1 / 3 + 30.5) / 2)
    assert html_text.threshold([2.0, 2.0]) == 2.0


def raw_pages():
    return [r["html"] or "" for r in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).to_pylist()]


def test_the_threshold_chooses_content_on_real_pages(monkeypatch):
    pages = raw_pages()
    texts = [html_text.extract(p) for p in pages]
    monkeypatch.setattr(html_text, "threshold", lambda values: 1e9)
    assert sum(html_text.extract(p) == t for p, t in zip(pages, texts, strict=True)) == 0


def test_pages_without_semantic_elements_give_the_same_text():
    pages = raw_pages()
    bare = [re.sub(r"<(/?)(?:article|main)\b[^>]*>", r"<\1div>", p) for p in pages]
    assert sum(html_text.extract(b) == html_text.extract(p) for b, p in zip(bare, pages, strict=True)) >= 0.97 * len(pages)


def test_a_short_second_article_stays():
    page = "<nav>a b c</nav><article><h1>One</h1><p>" + "first article words go on and on. " * 20 + "</p></article><article><h1>Two</h1><p>Short second article of a few words.</p></article><footer>foot</footer>"
    assert html_text.extract(page).split("\n\n")[-2:] == ["Two", "Short second article of a few words."]


def test_query(spark, sf_dir):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = QUERIES["op1_main_text"](spark, sf_dir).collect()
    assert sorted(r["page_id"] for r in got) == sorted(pages)
    for r in got:
        assert r["url"] == pages[r["page_id"]]["url"] and r["text"] == html_text.extract(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"])
        assert r["text"] and "<" not in r["text"] and all(b == " ".join(b.split()) for b in r["text"].split("\n\n"))


def test_edge_cases(spark):
    rows = spark.createDataFrame([(1, None, None, 0, "x"), (None, "u", f"<main><p>{LONG}</p></main>", 5, "y"), (1, None, "", 0, "x"), (1, None, "", 0, "x")], "page_id bigint, url string, html string, n int, title string")
    assert sorted((r["text"], r["n_chars"]) for r in html_text.main_text(rows, keep=["page_id", "url"]).collect()) == [("", 0)] * 3 + [(LONG, len(LONG))]
    assert html_text.main_text(rows.limit(0)).collect() == []
