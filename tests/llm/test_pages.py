import itertools

from hypothesis import given, settings
from hypothesis import strategies as st

from cadenza.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>x</title><script>var a = "<p>no</p>";</script></head><body>
<header class="site-header"><a href=/>Home</a> Site name</header><div id="cookie-notice">We use cookies.</div>
<main><article><header><h1>The headline</h1><p class="byline">By A. Author</p></header>
<p>First   paragraph is here &amp;&nbsp;long <b>enough</b> to count<br>as text.<p>Short.
<ul><li>One item in text<li>Another item</ul><div class="ad">Buy now!</div><aside>Related: foo</aside>
<blockquote><p>Quote it.</p></blockquote><form><label>Email</label><input><button>Go</button></form></article>
<section id="comments"><h2>Comments</h2><p>I really loved this article, it is a great piece of writing.</p></section></main>
<div class="sidebar"><p>Popular posts are listed in here.</p></div><nav><ul><li><a href=a>One</a></ul></nav>
<footer><p>Copyright 2020 something or other, all rights reserved.</p></footer></body></html>"""
TEXT = "The headline\nBy A. Author\nFirst paragraph is here & long enough to count as text.\nShort.\nOne item in text\nAnother item\nQuote it."


def test_article_without_its_surroundings():
    assert html_text.main_text(PAGE) == TEXT


def test_defined_cases():
    assert html_text.main_text("") == ""
    assert html_text.main_text("plain  words &lt; only") == "plain words < only"
    assert html_text.main_text("just <b text") == "just <b text"
    assert html_text.main_text("<article><p>one &am two &#x41;</article>") == "one &am two A"
    assert html_text.main_text("<script>x") == html_text.main_text("<!-- <p>a</p>") == ""


def cost(labels, scores, edges):
    unary = sum(max(-s, 0) if one else max(s, 0) for one, s in zip(labels, scores))
    return unary + sum(w for a, b, w in edges if labels[a] != labels[b])


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_cut_has_least_cost(data):
    n = data.draw(st.integers(1, 8))
    scores = data.draw(st.lists(st.floats(-4, 4), min_size=n, max_size=n))
    edges = data.draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1), st.floats(0, 3)).filter(lambda e: e[0] != e[1]), max_size=12))
    best = min(cost(x, scores, edges) for x in itertools.product([False, True], repeat=n))
    assert abs(cost(html_text.min_cut(scores, edges), scores, edges) - best) < 1e-6


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="<>/pdiva \"'=&;!-", max_size=80))
def test_no_markup_breaks_it(page):
    html_text.main_text(page)


def test_table(spark):
    long = "<article>" + "<p>Some words that make a paragraph.</p>" * 5000 + "</article>"
    rows = [(1, "u", PAGE), (2, None, None), (None, "u", ""), (1, "u", PAGE), (5, "v", long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'mine' as text", "3 as n_chars")
    got = [tuple(r) for r in html_text.extract(df).collect()]
    assert sorted(got, key=str) == sorted([(1, "u", TEXT, len(TEXT))] * 2 + [(2, None, "", 0), (None, "u", "", 0), (5, "v", "\n".join(["Some words that make a paragraph."] * 5000), 5000 * 34 - 1)], key=str)
    assert html_text.extract(df.limit(0)).count() == 0
