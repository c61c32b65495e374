from __future__ import annotations

import html
import re

import pytest
from pyspark.sql import functions as F

from adperf.llm import common, html_text, queries


def article_by_markup(source):
    """The blocks of the one article, by its own tags: what the given pages hold."""
    inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", inner)
    texts = (" ".join(html.unescape(re.sub(r"<br>", " ", b).replace("<b>", "")).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


def test_given_pages(spark, sf_dir):
    pages = {r.page_id: r for r in common.read(spark, sf_dir, "pages").collect()}
    rows = queries.op9_html_text(spark, sf_dir).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    wrong = [r.page_id for r in rows if r.text != article_by_markup(pages[r.page_id].html)]
    assert not wrong
    assert all(r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in rows)


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return html_text.fit(common.read(spark, sf_dir, "pages"))


LONG = "The council met on Monday and agreed to repair the old bridge before winter begins. "
OTHER = f"""<html><body><div class="cookie-notice"><p>We use cookies to improve your visit. Accept all of them now.</p></div>
<header><h1>The Daily</h1></header><nav><a href="/">Home</a> <a href="/b">News &amp; more</a></nav>
<div class="article-body"><h2>A bridge</h2><p>{LONG * 3}</p><p>Short &lt;one&gt;.</p>
<p>It &quot;was&quot;\n so <i>very</i> <a href="x">old</a>.<br>{LONG}</div>
<div id="comments"><p>{LONG} I do not agree with this at all.</p></div>
<aside><ul><li><a href="1">Other story</a><li><a href="2">More stories</a></ul></aside>
<form><p>Sign up for our letter and read it every week.</p><button>Go</button></form>
<footer>&copy; 2024</footer><script>if (a<b) document.write("<p>{LONG}</p>")</script></body></html>"""


def test_page_of_another_make(model):
    assert html_text.extract(model, OTHER) == "\n".join([
        "A bridge", (LONG * 3).strip(), "Short <one>.", f'It "was" so very old. {LONG.strip()}',
    ])


def test_remarks_within_an_article_go(model):
    page = f'<article><h1>T</h1><p>{LONG}</p><div class="comments"><p>{LONG}</p></div><div class="ad">Buy it.</div></article>'
    assert html_text.extract(model, page) == f"T\n{LONG.strip()}"


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<"), (4, "u", "<p <p>\"'<a href='x>"), (None, "u", "&amp; <!-- x"),
            (5, "u", "<div>" * 3000 + LONG), (6, "u", "<script>x"), (7, "u", f"<main><p>{LONG * 3000}</main>"),
            (7, "u", f"<main><p>{LONG * 3000}</main>")]
    pages = spark.createDataFrame([(*r, "t", 3) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    found = html_text.main_texts(pages).collect()
    assert len(found) == len(rows) and all(r.text is not None for r in found)
    assert [r.n_chars for r in found if r.page_id == 7] == [len(LONG * 3000) - 1] * 2
    assert html_text.main_texts(pages.where("false")).count() == 0


def test_marginals_equal_enumeration(model):
    page = html_text.Page(f"<div><p>{LONG}</p><ul><li><a>x</a></li></ul></div><p>y.")
    size = len(page.tag)
    weights = {}
    for code in range(1 << size):
        x = [code >> i & 1 for i in range(size)]
        w = (1.0, 1e-6)[x[0]] * model.node(page.look[0])[x[0]]
        for i in range(1, size):
            edge = model.edge(page.kind[i])
            w *= edge[x[page.parent[i]]][x[i]] * model.node(page.look[i])[x[i]]
        weights[code] = w
    total = sum(weights.values())
    exact = [sum(w for c, w in weights.items() if c >> i & 1) / total for i in range(size)]
    assert model.marginals(page) == pytest.approx(exact, abs=1e-6)


@pytest.mark.parametrize("head", [
    "<head><meta charset=utf-8><title>The title</title><style>p {}</style><body>",
    "<head><title>The title</title><script>var a</script>",
    "<head><title>The title</title></head><body>",
    "<head><title>The title</title><noframes><p>Old browser.</p></noframes><link rel=x><body class=a>",
    "<head><head><title>The title</title></head>",
    "<head><title>The title</title><noframes>Old browser.<body>",
])
def test_an_end_of_head_may_be_left_out(model, head):
    page = f"<!DOCTYPE html><html>{head}<article><h1>T</h1><p>{LONG}</p><p>{LONG * 2}</p></article></html>"
    assert html_text.extract(model, page) == f"T\n{LONG.strip()}\n{(LONG * 2).strip()}"


def test_given_pages_without_their_ends_of_head(spark, sf_dir):
    pages = common.read(spark, sf_dir, "pages")
    cut = pages.withColumn("html", F.regexp_replace("html", "(?i)</head>", ""))
    assert cut.where(F.lower("html").contains("<head")).count() > 0
    whole = {r.page_id: r.text for r in html_text.main_texts(pages).collect()}
    assert {r.page_id: r.text for r in html_text.main_texts(cut).collect()} == whole


def test_text_in_a_head_ends_it():
    assert html_text.Page("<head><title>t</title>\n Plain text.").text[1:] == ["Plain text."]
