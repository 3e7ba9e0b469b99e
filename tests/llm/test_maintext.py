"""Main text of pages written by hand and of the given pages."""
import html
import re
import time

import pytest

from adlattice.llm import maintext

LONG = "This paragraph says quite a lot about its subject, in plain words and with few tags. "


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


@pytest.mark.parametrize("body, want", [
    (f"<article><h1>Title</h1><p>{LONG}</p><p>Be.</p></article>", ["Title", LONG, "Be."]),
    (f"<header>Site</header><nav><a href=/>a</a></nav><main><p>{LONG}<p>{LONG}<br>x</main><footer>f</footer>", [LONG, LONG + "x"]),
    (f"<div class='cookie-notice'>{LONG * 3}</div><div><p>{LONG}</p></div>", [LONG]),
    (f"<article><p>{LONG}</p><section id=comments><p>{LONG * 2}</p></section></article>", [LONG]),
    (f"<article><p>{LONG}</p><div class='ad'>{LONG}</div><aside>{LONG}</aside><form>{LONG}<input></form><p>End</p></article>", [LONG, "End"]),
    (f"<div><h2>One</h2><section><p>{LONG}</p></section><section><p>{LONG}</p><ul><li>a<li>b</ul></section></div>", ["One", LONG, LONG, "a", "b"]),
    (f"<p>{LONG}<!-- no <p>this</p> --><script>if (a < b) {{ '</p>' }}</script> 1 &lt; 2 &amp; 3 &eacute;&#233;</p>", [LONG + "1 < 2 & 3 éé"]),
    (f"<p>{LONG}</p><table><tr><td>x<td>y</table>", [LONG, "x", "y"]),
])
def test_pages(body, want):
    assert maintext.main_text(page(body)) == "\n".join(" ".join(w.split()) for w in want)


@pytest.mark.parametrize("body, want", [
    (f"<main><h1>A headline of some forty characters here</h1><div><p>{LONG * 7}</p><p>{LONG * 7}</p></div></main>", ["A headline of some forty characters here", LONG * 7, LONG * 7]),
    (f"<main><section><p>{LONG}</p></section><section><p>{LONG * 7}</p><p>{LONG * 7}</p></section></main>", [LONG, LONG * 7, LONG * 7]),
    (f"<h1>Headline</h1><div><p>{LONG * 7}</p><p>{LONG * 7}</p></div>", ["Headline", LONG * 7, LONG * 7]),
    (f"<div><h1>Headline</h1><article><p>{LONG * 7}</p></article></div>", ["Headline", LONG * 7]),
])
def test_short_parts_beside_a_long_one(body, want):
    assert maintext.main_text(page(body)) == "\n".join(" ".join(w.split()) for w in want)


@pytest.mark.parametrize("part", ["div class='content no-sidebar'", "div class='post has-comments'", "section id='search-basics'", "form action=/", "div class='with-banner'"])
def test_names_and_forms_do_not_cut_the_article(part):
    got = maintext.main_text(page(f"<nav><a href=/>a</a></nav><{part}><h1>Title</h1><p>{LONG * 3}</p><div class=ad>Buy this</div><p>x <span class=ad>y</span>z</p></{part.split()[0]}>"))
    assert got == "\n".join(["Title", (LONG * 3).strip(), "x z"])


@pytest.mark.parametrize("part, title", [("h2 id='search'", "Search basics"), ("h2 id='copyright'", "Copyright"), ("section id='related-work'", "Related work"),
                                         ("div class='social-history'", "Social history"), ("div class='share-price'", "Share price"), ("section class='login-flow x'", "Login flow")])
def test_words_of_a_name_do_not_cut_an_article(part, title):
    tag = part.split()[0]
    body = f"<{part}>{title}</{tag}>" if tag == "h2" else f"<{part}><p>{title}</p><p>{LONG}</p></{tag}>"
    got = maintext.main_text(page(f"<article><h1>Top</h1><p>{LONG}</p>{body}<p>{LONG}</p></article>"))
    assert got == "\n".join(["Top", LONG.strip(), title, *([] if tag == "h2" else [LONG.strip()]), LONG.strip()])


@pytest.mark.parametrize("part", ["div class=ad", "div class='x share-buttons'", "section id=comments", "ul class='related-posts'", "div role=complementary", "div class='cookie-notice'", "div id=newsletter-signup"])
def test_whole_names_cut_a_part(part):
    got = maintext.main_text(page(f"<article><h1>Top</h1><p>{LONG}</p><{part}><p>{LONG * 2}</p><p>{LONG * 2}</p><p>{LONG * 2}</p></{part.split()[0]}><p>End</p></article>"))
    assert got == "\n".join(["Top", LONG.strip(), "End"])


def test_end_tags_of_what_is_not_open_cost_nothing():
    start = time.perf_counter()
    assert maintext.main_text("<div>" * 20_000 + "x" + "</b></section>" * 20_000).endswith("x")
    assert maintext.main_text("<div><li></li>" * 5_000 + "x").endswith("x")
    assert time.perf_counter() - start < 3


@pytest.mark.parametrize("bad, want", [(None, ""), ("", ""), ("<p>cut <b", "cut"), ("plain", "plain"), ("a < b", "a < b"), ("<!-- open", ""), ("<script>x", ""), ("<nav>x</nav>", ""), ("</p></div>x", "x"), ('<p a="open>x</p>', "x")])
def test_broken(bad, want):
    assert maintext.main_text(bad) == want


def test_large_pages_stay_fast():
    assert maintext.main_text("<div>" * 20_000 + "x").endswith("x")
    assert len(maintext.main_text("<p>" + "w " * 1_000_000)) == 1_999_999


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    rows = maintext.extract(pages.withColumnRenamed("url", "text").withColumnRenamed("text", "url")).collect()
    assert len(rows) == len(source)
    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", source[r["page_id"]], re.S)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inner))
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_null_and_empty(spark):
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert maintext.extract(none).count() == 0
    rows = maintext.extract(spark.createDataFrame([(None, None, None), (1, "u", "x"), (1, "u", "x")], "page_id bigint, url string, html string")).collect()
    assert sorted((r["text"], r["n_chars"]) for r in rows) == [("", 0), ("x", 1), ("x", 1)]
