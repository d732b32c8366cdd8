"""Main text of pages: the cutting into blocks, the tree, and pages that it was not grown on."""

import html
import re

import numpy as np

from knapline.llm import extract

SCHEMA = "page_id long, url string, html string, text string, n_chars int, `N_words` int"
PAGE = """<!DOCTYPE html><html><head><title>Not this</title><style>p{color:red}</style><script>if (a<b) document.write("<p>no</p>")</script></head>
<body><div id="top-header"><a href=/>Site</a></div><div class="main-menu"><a>Home</a> <a>News</a> <a>About us</a></div>
<div class="cookie-notice"><p>We use cookies to make this site better for you and for everybody else who reads it. <a>Accept</a></p></div>
<div class="post has-sidebar"><header class="entry-header"><h1>A   title&nbsp;here</h1></header>
<p>A first paragraph of some length&mdash;that goes <b>on</b>\n &amp; <a href="x?a=1&b=2">on</a>.</p><!-- <p>not this</p> --><p>Short.<p>Un<i>closed</i><br>line<blockquote>Quote &lt;me&gt;</blockquote>
<ul><li>one item<li>two</ul><table><tr><td>cell a<td>cell b</table><div class="share-links"><a>Tweet this</a><a>Like it</a></div><p title="a > b">The last one of them.</div>
<aside><h2>Related</h2><p>Long text in the side bar that is about something else entirely and so on and on.</aside>
<div class="adBox"><p>Buy now, buy cheap, buy all of the many things that nobody ever needed in any house.</p></div>
<div class="Banner300"><p>Another one of these that stands in the middle of everything that one wants to read.</p></div>
<section id=comments><article class=comment><p>I totally agree with this author about all of the many points that they make.</p></article></section>
<form><label>Name</label><input name=x><p>Please type your name here and mail it to us at once.</p></form><footer>Copyright 2020 by all of us</footer></body></html>"""
MAIN = "A title here\nA first paragraph of some length—that goes on & on.\nShort.\nUnclosed line\nQuote <me>\none item\ntwo\ncell a\ncell b\nThe last one of them."


def one(page):
    return extract.main_texts([page], extract.trained())[0]


def test_tree_fits_its_table_and_uses_neighbours():
    x, y = extract.labelled()
    tree = extract.trained()
    assert ((tree.share(x) > 0.5) == y).mean() > 0.97
    used = {extract.FEATURES[int(f)] for f in tree.table[:, 0] if f >= 0}
    assert used & {"before", "density_before", "after", "density_after"} and {"density", "beside"} <= used


def test_tree_splits_as_gini_says():
    x = np.array([[0, 5], [1, 5], [2, 0], [3, 0]], float)
    tree = extract.Tree(x, np.array([False, False, True, True]))
    assert tree.nodes[0][:2] == [0, 1.5] and tree.share(x).tolist() == [0, 0, 1, 1]
    assert extract.Tree(x, np.array([True] * 4)).share(x).tolist() == [1] * 4


def test_other_layouts():
    assert one(PAGE) == MAIN
    assert one(PAGE.replace("<div class=\"post has-sidebar\">", "<main>").replace("one of them.</div>", "one of them.</main>")) == MAIN
    assert one("<article><p>only") == "only"
    assert one("<nav><a>a</a></nav><article><h1>T</h1><p>x</p></article>") == "T\nx"
    assert one("<p>Just one plain paragraph of words without anything else at all.") == "Just one plain paragraph of words without anything else at all."
    assert one("<div><a>x</a> | <a>y</a></div>") == one("") == one("<") == ""
    plain = "<div><a>Home</a></div><div>" + "</div><div>".join(["word " * 60, "few words here", "more " * 80]) + "</div><div>(c) 2020</div>"
    assert one(plain).split("\n")[1] == "few words here" and "2020" not in one(plain)


def test_broken_markup_ends_somewhere():
    for part in ("<div>", "</div>", "<p", "<a href='", '<a b="', "<!--", "<!", "<script>", "<svg>", "&", "&#", "&#x110000;", "<a =>", "< ", "</", "<li><a>", "<form>", "\0", '"<', "'>"):
        for page in (part * 3_000, part + "<p>tail of the page", "<article>" + part * 200 + "</article><p>x"):
            assert isinstance(one(page), str)
    assert one("<article><p>a < b and c > d <3</article>") == "a < b and c > d <3"
    assert one("<article><p>it &am it &amp it &#8212; &copy</article>") == "it &am it & it — ©"
    deep = "<div>" * 5_000 + "</section>" * 5_000 + "<p>text that is long enough to be kept as it has ten words"
    assert one(deep).startswith("text that")


def test_given_pages(spark):
    """What stands in the article element of each of the given pages, nothing else, is its text."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html_of = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in extract.extract(pages).collect():
        inner = re.search(r"<article>(.*)</article>", html_of[r["page_id"]], re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_odd_rows(spark):
    rows = [(1, "u", None, "x", 1, 1), (1, "u", None, "x", 1, 1), (None, None, PAGE, None, None, None), (2, None, "", None, None, None), (3, "v", "<article>" + "<p>word 日本</p>" * 20_000, None, None, None), (4, "", " \n", None, None, None)]
    got = sorted((r["page_id"] or 0, r["url"], r["text"], r["n_chars"]) for r in extract.extract(spark.createDataFrame(rows, SCHEMA)).where("page_id is not null").fillna("?", ["url"]).collect())
    assert got == [(1, "u", "", 0), (1, "u", "", 0), (2, "?", "", 0), (3, "v", "\n".join(["word 日本"] * 20_000), 20_000 * 8 - 1), (4, "", "", 0)]
    assert [r["text"] for r in extract.extract(spark.createDataFrame(rows, SCHEMA)).where("page_id is null").collect()] == [MAIN]
    assert extract.extract(spark.createDataFrame([], SCHEMA)).count() == 0
