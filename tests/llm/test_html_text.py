import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from shelfsift.llm import html_text

P1 = "The first paragraph has a fair number of words, so that it looks like prose."
P2 = "The second one is about as long as the first & says nothing new either."
BOILER = (
    '<header><a href="/">Site name</a></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>'
    '<aside class="sidebar"><p>Most read this week, and some more text for the side.</p></aside>'
    '<div id="cookie-notice">We use cookies to make things better for everybody who visits.</div>'
    '<form><label>Mail</label><input name="m"><button>Go</button></form>')
END = (
    '<section class="comments"><p>Reader: I disagree with all of this, as long as it may be.</p></section>'
    '<div class="ad-banner">Buy now, only today, only here.</div><footer>&copy; Somebody, all rights reserved</footer>')


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><script>var t='</p>';</script><style>p{{}}</style></head><body>{body}</body></html>"


@pytest.mark.parametrize("article", [
    f"<article><h1>Title</h1><p>{P1}</p><p>{P2.replace('&', '&amp;')}</p></article>",
    f"<div class='post'><h1>Title</h1><p><b>{P1}<br><p>{P2}</div>",
    f"<main><header><h1>Title</h1></header><div><div><p>{P1}</p></div><p>{P2.replace('&', '&#38;')}</p></div></main>",
])
def test_article_without_its_surroundings(article):
    assert html_text.main_text(page(BOILER + article + END)) == f"Title\n{P1}\n{P2}"


ARTICLE = f"<h1>Title</h1><p>{P1}</p><p>{P2.replace('&', '&amp;')}</p>"


@pytest.mark.parametrize("wrapper", [
    'style="overflow:hidden"', 'aria-hidden="false"', 'class="layout with-sidebar"', 'class="page-layout search-layout"',
    'data-x="display:none hidden"', 'class="hidden-xs-none visible"', 'class="sidebar"', "title='hidden sidebar'"])
@pytest.mark.parametrize("article", [f"<article>{ARTICLE}</article>", f"<main role=main>{ARTICLE}</main>"])
def test_wrappers_of_the_article(wrapper, article):
    assert html_text.main_text(page(f"{BOILER}<div {wrapper}>{article}</div>{END}")) == f"Title\n{P1}\n{P2}"


def test_an_article_in_a_sidebar_is_not_the_page():
    side = "<div class='sidebar'><article><p>Also read this teaser.</p></article></div>"
    comments = "<section id=comments><article><p>" + "A reader with a long opinion. " * 30 + "</p></article></section>"
    assert html_text.main_text(page(f"<div class=post>{ARTICLE}</div>{side}{comments}")) == f"Title\n{P1}\n{P2}"


@pytest.mark.parametrize("inside,text", [
    ('a <a href="/the-hidden-valley">valley</a> b', "a valley b"), ('a <span class="search">word</span> b', "a word b"),
    ('a <a title="the hidden cost">cost</a> b', "a cost b"), ('a <i hidden>x</i>b', "a b"), ('a <span style="display: none">x</span>b', "a b"),
    ('<a href="/a">Ann</a>, <a href="/b">Bob</a>, <a href="/c">Cid</a>', "Ann, Bob, Cid"),
    ('</p><ul><li><a href="/a">Ann</a></li><li><a href="/b">Bob</a></li><li><a href="/c">Cid</a></li></ul><p>', "Ann\nBob\nCid"),
    ('</p><table><tr><td>1</td><td>2</td></tr></table><p>', "1\n2"), ('a <span class="ad">Buy</span> b', "a b")])
def test_nothing_inside_the_article_is_lost(inside, text):
    html = page(f"{BOILER}<article><p>{P1}</p><p>{inside}</p><p>{P2.replace('&', '&amp;')}</p></article>{END}")
    assert html_text.main_text(html) == f"{P1}\n{text}\n{P2}"


@pytest.mark.parametrize("attribute", [
    "hidden", 'hidden=""', 'aria-hidden="true"', 'style="color:red; display : none"', 'class="hidden"', 'class="x ad-box"', "role=navigation"])
def test_blocks_that_are_not_shown(attribute):
    html = page(f"<article>{ARTICLE}<div {attribute}><p>{P1}</p></div></article>")
    assert html_text.main_text(html) == f"Title\n{P1}\n{P2}"


def test_blocks_and_references():
    text = html_text.main_text("<p>a\n  <b>b</b>c &eacute;&nbsp;&#x41;<br>d</p><!-- x --><ul><li>e<li>f</ul>")
    assert text == "a bc é A d\ne\nf"


def test_nothing():
    assert [html_text.main_text(x) for x in (None, "", "<p> </p>", "<script>x", "<!-- open")] == [""] * 5
    assert html_text.main_text("plain text < more") == "plain text < more"


def test_very_deep_and_long():
    assert html_text.main_text("<div>" * 20_000 + "deep").endswith("deep")
    assert html_text.main_text("<p>word " * 20_000).count("\n") == 19_999


@given(st.text(st.sampled_from("<>/!-pdivab \"'=&;#")))
def test_any_markup(html):
    assert "  " not in html_text.main_text(html)


def test_pages(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    rows = {r.page_id: r.text for r in html_text.extract(pages, ["page_id"]).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", r.html or "", re.S)
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>|<br>", " ", article[1])) if article else []
        lines = (" ".join(html_text.unescape(b).split()) for b in blocks)
        assert rows[r.page_id] == "\n".join(filter(None, lines))


def test_odd_rows(spark, empty):
    rows = [(None, None, None, "t", 0), (1, "u", "", "t", 0), (1, "u", "<p>x</p>", "t", 0), (1, "u", "<p>x</p>", None, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, __html int")
    found = html_text.extract(pages, ["page_id", "url"]).collect()
    assert sorted((str(r.page_id), r.url, r.text) for r in found) == [
        ("1", "u", ""), ("1", "u", "x"), ("1", "u", "x"), ("None", None, "")]
    assert html_text.extract(pages.limit(0), ["page_id", "url"]).count() == 0
