import itertools
import math

import numpy as np
import pytest

from cohortlens.llm import html_main as hm
from cohortlens.llm.dom import attributes, parse
from cohortlens.llm.linear import HashedLinear

LONG = "This is a sentence of some length that a reader would read. And here is another one, which goes on."


@pytest.fixture(scope="module")
def model(spark):
    return hm.fit(spark)


def test_marginals_against_all_labelings():
    rng = np.random.default_rng(0)
    page = parse("<body>a<div>b<p>c</p><p>d. e</p></div><nav><ul><li>f</li></ul></nav></body>")
    weights = rng.normal(0, 1, 1 << 18).astype(np.float32)
    model = hm.TreeModel(HashedLinear(weights, 0.3), rng.normal(0, 1, (3, 2, 2)).tolist())
    n = len(page.nodes)
    unary = [0.3 + float(weights[ids].sum()) for ids in hm.features(page)]
    total, yes = 0.0, np.zeros(n)
    for y in itertools.product([0, 1], repeat=n):
        e = sum(u for u, v in zip(unary, y) if v) + sum(model.pairs[hm.kind(c)][y[c.parent]][y[i]] for i, c in enumerate(page.nodes) if i)
        total += math.exp(e)
        yes += math.exp(e) * np.array(y)
    assert np.allclose(model.marginals(page), yes / total)


def runs(html):
    return [t for _, t in parse(html).runs]


@pytest.mark.parametrize("html,want", [
    ("<p>a <b>b</b>\n c<br>d</p>", ["a b c d"]),
    ("<p>one<p>two<div>three</div>four", ["one", "two", "three", "four"]),
    ("<p><b>open<br><p>next</p>", ["open", "next"]),
    ("<ul><li>x<ul><li>y</ul><li>z</ul>", ["x", "y", "z"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
    ("x<!-- <p>no</p> -->y<script>var t='</p>';</script>z<style>p{}</style>", ["xyz"]),
    ("a &lt;b&gt; &amp;amp; &#228;&nbsp;&copy; &am", ["a <b> &amp; ä © &am"]),
    ("<head><title>no</title></head><body><p>yes", ["yes"]),
    ("a < b and c <3 d", ["a < b and c <3 d"]),
    ('<p title="a > b">t</p>', ["t"]), ("", []), ("   ", []), ("<p></p></div></p>", []), ("just text", ["just text"]), ("<!-- open", []),
    ("<SCRIPT>x</SCRIPT><P>Y</P>", ["Y"]), ("<p>a</p>\x00b", ["a", "\x00b"]),
])
def test_parse(html, want):
    assert runs(html) == want


@pytest.mark.parametrize("html,want", [
    ('<p class=x">First text</p><p>Second</p><a href="/y">link</a>', ["First text", "Second", "link"]),
    ("<p title=Bob's>one</p><p>it's</p>", ["one", "it's"]),
    ("<p title=Bob's>one</p>", ["one"]), ('<p "x>a</p><p id="y">b</p>', ["a", "b"]), ("<p class=''x'>a</p><p>b's</p>", ["a", "b's"]),
    ('<p a=b="c>d</p><p>e"</p>', ["d", 'e"']), ('<p class="x>a</p>', ["a"]), ("<p class = 'a > b' id=\"c>d\"e>f</p>", ["f"]),
    ("</p\">a<p =\"x>b</p>\"", ["a", "b", '"']),
])
def test_stray_quotes(html, want):
    assert runs(html) == want


def test_attributes():
    assert attributes(" class=x\" id='a b' = y Data-X=\"1 > 0\" href=/a/b?c=d checked/") == {
        "class": 'x"', "id": "a b", "=": "", "y": "", "data-x": "1 > 0", "href": "/a/b?c=d", "checked": ""}


PAGES = {
    "article": f"<nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>Title</h1><p>{LONG}</p><p>Short.</p></article><footer>&copy; 2020 me</footer>",
    "ads inside": f'<main><h1>Title</h1><p>{LONG}</p><div class="ad">Buy now</div><p>Short.</p></main>',
    "comments": f'<div class="content"><h1>Title</h1><p>{LONG}</p><p>Short.</p></div><div class="comments"><h3>Comments</h3><div class="comment"><p>{LONG}</p></div></div>',
    "comments inside": f'<article><h1>Title</h1><p>{LONG}</p><p>Short.</p><section class="comments"><div class="comment"><p>{LONG}</p></div></section></article>',
    "cookies": f'<div class="cookie-notice"><p>{LONG}</p></div><article><h1>Title</h1><p>{LONG}</p><p>Short.</p></article>',
    "aside": f'<aside class="sidebar"><h3>More</h3><p>{LONG}</p></aside><div id="main-content"><h1>Title</h1><p>{LONG}</p><p>Short.</p></div>',
    "header": f'<header class="site-header"><h1>My site</h1><a href=x>a</a></header><main><h1>Title</h1><p>{LONG}</p><p>Short.</p></main><form><p>{LONG}</p></form>',
    "article header": f"<article><header><h1>Title</h1></header><p>{LONG}</p><p>Short.</p></article><aside>{LONG}</aside>",
    "alert": f'<div role="alert">{LONG}</div><article><h1>Title</h1><p>{LONG}</p><p>Short.</p></article><div class="newsletter"><p>{LONG}</p></div>',
}


@pytest.mark.parametrize("name", PAGES)
def test_other_layouts(model, name):
    assert model.text(f"<html><body>{PAGES[name]}</body></html>") == f"Title\n\n{LONG}\n\nShort."


def test_composed_pages_held_out(model):
    right = total = 0
    for html in hm.composed_pages(200, seed=99):
        page = parse(html)
        p, y = model.marginals(page), hm.labels(page)
        for node, text in page.runs:
            right += len(text) * ((p[node] >= 0.5) == (y[node] == 1))
            total += len(text)
    assert right / total > 0.95


def test_query_rows(spark, model):
    rows = [(1, "u", PAGES["article"]), (2, None, None), (3, "v", ""), (None, "w", "plain"), (1, "u", PAGES["article"]), (4, "x", "<p>" * 5000 + "deep")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'c' AS text", "1 AS n_chars", "0 AS id")
    got = hm.main_texts(df).collect()
    assert got[0].__fields__ == ["page_id", "url", "text", "n_chars"] and len(got) == 6
    assert [r.text for r in got if r.page_id in (2, 3)] == ["", ""]
    assert all(r.n_chars == len(r.text) for r in got)
    assert hm.main_texts(df.where("page_id < 0")).count() == 0
