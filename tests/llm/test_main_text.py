"""HTML blocks, the labeller's gradient, and main texts of pages whose article is known."""

from __future__ import annotations

import html
import re

import duckdb
import numpy as np
import pytest


def texts(page):
    from tessera.llm.leaves import leaves

    return [leaf.text for leaf in leaves(page)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, []),
        ("", []),
        ("plain &lt;b&gt; text", ["plain <b> text"]),
        ("<p>one<p>two</p>three", ["one", "two", "three"]),
        ("<p>a <b>b</b><i>c</i>\n\t d<br>e</p>", ["a bc d e"]),
        ("<ul><li>x<li>y<ul><li>z</ul></ul>", ["x", "y", "z"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
        ("<script>var t='</p>';</script><style>p{}</style><p>x<!-- <p>no</p> --></p>", ["x"]),
        ("<SCRIPT>never ends <p>no", []),
        ("<p>x<!-- never ends <p>no", ["x"]),
        ("<head><title>t</title><meta x></head><body>b", ["b"]),
        ("<head><title>t</title><body>b", ["b"]),
        ("<head><meta x><p>no body", ["no body"]),
        ('<div title="a > b">c</div>', ["c"]),
        ("<p class=\"x>y</p><p>z</p>", ["y", "z"]),
        ("1 < 2 and 3 <4", ["1 < 2 and 3 <4"]),
        ("<pre>a\n  b &amp;&nbsp;c</pre>", ["a b & c"]),
        ("</div></p>stray</article> ends", ["stray", "ends"]),
        ("<dl><dt>k<dd>v</dl><select><option>1<option>2</select>", ["k", "v", "1", "2"]),
        ("<svg><text>no</text></svg><iframe src=x>no</iframe>yes", ["yes"]),
        ("caf&eacute &#233; &am</h1> &#x1F600;", ["café é &am", "😀"]),
    ],
)
def test_blocks(page, want):
    assert texts(page) == want


def test_names_and_links():
    from tessera.llm.leaves import leaves

    page = '<div id="mainNav" class="top-bar x1"><ul><li><a href=1>one two</a> three</ul></div><p>out'
    first, second = leaves(page)
    assert first.path == ("div", "top", "bar", "x", "main", "nav", "ul", "li") or set(first.path) == {"div", "top", "bar", "x", "main", "nav", "ul", "li"}
    assert first.near == ("around ul", "li") and first.linked == 7 and first.text == "one two three"
    assert second.path == ("p",) and second.linked == 0
    assert "!hidden" in leaves('<div style="display: none">x</div>')[0].path
    deep = "<div>" * 30_000 + "x"
    assert leaves(deep)[0].path == ("div",)


def test_gradient_is_the_slope():
    from tessera.llm import labelling as L
    from tessera.llm.sample_pages import pages

    batch = [L.labelled(p) for p in pages(5, 4)]
    encoded, truth = [e for e, _ in batch], [t for _, t in batch]
    model, rng = L.Labeller(1), np.random.default_rng(0)
    grad = model.gradient(encoded, truth)[1]
    for name, value in model.p.items():
        flat, slope = value.ravel(), grad[name].ravel()
        for i in {*rng.integers(0, len(flat), 6).tolist(), int(np.argmax(np.abs(slope)))}:
            old, losses = flat[i], []
            for step in (1e-5, -1e-5):
                flat[i] = old + step
                losses.append(model.gradient(encoded, truth)[0])
            flat[i] = old
            assert abs((losses[0] - losses[1]) / 2e-5 - slope[i]) < 1e-6 + 1e-4 * abs(slope[i]), name


def test_padding_and_company_do_not_matter():
    from tessera.llm import labelling as L
    from tessera.llm.sample_pages import pages

    batch = [L.labelled(p)[0] for p in pages(6, 8)]
    model = L.trained()
    for alone, together in zip([model.scores([e])[0] for e in batch], model.scores(batch), strict=True):
        assert np.allclose(alone, together)


def test_pages_that_it_was_not_trained_on():
    from tessera.llm import labelling as L
    from tessera.llm.sample_pages import pages

    model = L.trained()
    right = blocks = 0
    for page in pages(99, 250):
        e, truth = L.labelled(page)
        right += int(((model.scores([e])[0] > 0) == (truth > 0)).sum())
        blocks += e.n
    assert right / blocks > 0.99


def article_text(page):
    """By hand: what stands between the article's tags."""
    inner = page[page.index("<article>") + 9 :].split("</article>")[0]
    found = [" ".join(html.unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:h1|p)>", inner)]
    return "\n".join(b for b in found if b)


def test_query_gives_the_articles(spark):
    from tessera.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in QUERIES["op13_html_extraction"](spark, sf).collect()}
    rows = duckdb.sql(f"SELECT page_id, url, html FROM '{sf}/pages.parquet'").fetchall()
    assert len(got) == len(rows)
    for page_id, url, page in rows:
        want = article_text(page)
        assert (got[page_id].url, got[page_id].text, got[page_id].n_chars) == (url, want, len(want))


NEWS = """<html><head><title>T</title></head><body><div class="cookie-banner">We use cookies to improve this site. <button>Accept</button></div>
<header><a href=/>The Daily</a><nav><a href=1>World</a> <a href=2>Sport</a></nav></header>
<div class="content"><h1>A bridge reopens</h1><p>The bridge over the river was opened again on Monday, after two years of work.</p>
<div class="ad">Buy our cheap shoes today.</div><p>Engineers replaced the deck and the cables.</p><blockquote>It was a hard winter.</blockquote>
<form class="newsletter"><label>Email address</label><input><button>Subscribe</button></form><p>Traffic starts at noon &amp; tolls stay.</p></div>
<aside class="sidebar"><h3>Most read</h3><ul><li><a href=3>Storm hits coast</a><li><a href=4>New mayor elected</a></ul></aside>
<div id="comments"><h3>2 comments</h3><div class="comment"><p>anna</p><p>Great news, I have waited so long for this.</p></div><div class="comment"><p>ben</p><p>The tolls are too high.</p></div></div>
<footer><p>&copy; 2024 The Daily. All rights reserved.</p></footer></body></html>"""


def test_a_page_of_another_kind_and_awkward_rows(spark):
    from tessera.llm import labelling as L

    schema = "page_id long, url string, html string, text string, n_chars int, `a.b` int"
    rows = [(1, "u", NEWS), (1, "u", NEWS), (None, None, None), (2, "v", ""), (3, None, "<p></p><nav><a href=1>Home</a></nav>"), (4, "w", "<p>Only one paragraph of a short text.</p>"), (5, "x", "<article>" + "<p>Word after word goes on here.</p>" * 30_000 + "</article>")]
    got = {(r.page_id, r.url): r for r in L.extract_main(spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], schema).repartition(3)).collect()}
    assert len(got) == 6
    want = ["A bridge reopens", "The bridge over the river was opened again on Monday, after two years of work.", "Engineers replaced the deck and the cables.", "It was a hard winter.", "Traffic starts at noon & tolls stay."]
    assert got[1, "u"].text.split("\n") == want
    assert got[None, None].text == got[2, "v"].text == got[3, None].text == "" and got[2, "v"].n_chars == 0
    assert got[4, "w"].text == "Only one paragraph of a short text."
    assert got[5, "x"].text.count("\n") == 29_999
    assert L.extract_main(spark.createDataFrame([], schema)).collect() == []
