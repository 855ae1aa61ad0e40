import itertools
import random

import numpy as np
from conftest_llm import SF

from specmap.llm import html

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="</p><p>No";</script></head><body class="has-sidebar">
<header><h1>No site</h1></header><nav><ul><li><a href="/">No</a></li></ul></nav><!-- No <p>No</p> --><div class="cookie-notice">No cookies.</div>
<article><header><h2>A title &amp; more</h2></header><p>First <b>bold</b>,&nbsp;then
   a <a href="x>y">link</a>.<p>Second &lt;b&gt; 3 < 4.<br>After a break.</p><div class="ad">No advert.</div><ul><li>One<li>Two</ul>
<aside>No aside.</aside><section class="comments"><p>No comment.</p></section></article>
<div id="sidebar"><p>No sidebar, which is a long and quite complete sentence with many words in it.</p></div><form><p>No form</p></form><footer>No &copy;</footer>"""


def test_a_page():
    weights = np.zeros(len(html.SHAPE))
    assert html.extract(PAGE, weights) == "A title & more\n\nFirst bold, then a link.\n\nSecond <b> 3 < 4. After a break.\n\nOne\n\nTwo"


def test_cuts_are_minimal():
    draw = random.Random(1)
    for _ in range(300):
        n = draw.randint(1, 9)
        gain = [draw.uniform(-3, 3) for _ in range(n)]
        links = [(i, j, draw.uniform(0, 2)) for i in range(n) for j in range(i + 1, min(n, i + 4)) if draw.random() < 0.8]

        def cost(label, gain=gain, links=links):
            return sum(abs(g) for g, x in zip(gain, label, strict=True) if (g > 0) != x) + sum(w for i, j, w in links if label[i] != label[j])

        assert abs(cost(html.minimum_cut(gain, links)) - min(map(cost, itertools.product([False, True], repeat=n)))) < 1e-9


def test_pages_equal_their_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    weights = html.train(pages)
    assert weights[html.SHAPE.index("links")] < 0 < weights[html.SHAPE.index("words")]
    rows = pages.collect()
    got = {r["page_id"]: r for r in html.main_text(pages, weights).collect()}
    import html as reference
    import re

    for r in rows:
        article = re.search(r"(?s)<article>(.*?)</article>", r["html"])[1]
        parts = [" ".join(reference.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("</?(?:p|h1)>", article)]
        text = "\n\n".join(p for p in parts if p)
        assert got[r["page_id"]]["text"] == text and got[r["page_id"]]["n_chars"] == len(text)


def test_odd_pages(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p>a", "x"), (4, "u", "<<<>>><p", "x"), (5, "u", "<script>never closed", "x"), (6, "u", "<div>" * 3000 + "deep", "x"), (6, "u", "<article>" + "<p>word word</p>" * 5000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html.main_text(pages, html.train(pages)).collect()
    assert len(out) == len(rows)
    assert all(r["text"] == "" and r["n_chars"] == 0 for r in out if r["page_id"] in (1, 2, 5))
    assert max(r["n_chars"] for r in out) == 5000 * 11 - 2
    assert html.main_text(pages.limit(0), np.zeros(len(html.SHAPE))).count() == 0


def test_nothing_of_an_article_is_skipped_unread():
    got = lambda page: html.extract(page, np.zeros(len(html.SHAPE)))
    assert got('<article><p>One <svg class="icon"/> two</p><p>Three <math/> four</p><p>Five</p></article>') == "One two\n\nThree four\n\nFive"
    assert got("<article><p>One <svg><path d='m'></p><p>Two</p></article>") == "One\n\nTwo"
    assert got("<article><p>One <svg><text>No</text></svg> two</p></article>") == "One two"
    for head in ("<head><title>No</title>", "<head><meta charset=utf-8><style>p > a{}</style><!-- <p> -->", "<head>", "<head><title>No</head>", "<head><title>No</title></head>"):
        assert got(f"<html>{head}<article><p>One</p></article>") == "One"
    assert got("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> be.</p></article>") == "Let x=1 be."
    for tag, names in (("article", "post category-advertising"), ("main", "content has-sidebar"), ("article", "widget-share tag-legal"), ("div", "post type-post tag-search"), ("div", "entry-content")):
        assert got(f'<{tag} class="{names}"><p>One</p></{tag}><div class="site-header">No</div><footer>No</footer>') == "One"
    for names in ("sidebar", "cookie-notice", "widget_text", "post-comments", "sidebar-left"):
        assert got(f'<main><p>One</p><div class="{names}"><p>No</p></div></main>') == "One"
    assert got('<article><header class="entry-header"><h1>Title</h1></header><p>One</p></article>') == "Title\n\nOne"
