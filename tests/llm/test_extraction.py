"""Main text of web pages: markup, what is left out, and the host's vote."""

import random
import time

import pytest
from pyspark.sql import functions as F

from marginalia.llm import extraction
from marginalia.llm.extraction import Page

SCHEMA = "page_id long, url string, html string"


@pytest.mark.parametrize("source, text", [
    ("<article><header><h1>T</h1></header><p>one  two<aside>x</aside><p>three</article>", "T one two three"),
    ("<article><header><a href=/>home</a></header><p>one two</article>", "one two"),
    ("<form id=f><main><article><p>in a form</p></article></main></form>", "in a form"),
    ("<main><p>long enough text</p><form><p>Your name</p><input></form></main>", "long enough text"),
    ("plain &amp; &lt;b&gt; a < b", "plain & <b> a < b"),
    ("<script>var a='</p>';</script>only<style>x", "only"),
    ("<p>un<b>closed<br>next<p>p <a title='x>y' href=q>link</a> end</p></b></div>tail", "unclosed next p link end tail"),
    ("<div class=cookie-notice>we</div><main><p>A</p><div class='ad top'>buy</div><ul><li>1<li>2</ul><table><tr><td>c<td>d</table></main>",
     "A 1 2 c d"),
    ("<title>t</title><body><p>x&nbsp;y\n z&#8212;q</p><!-- c <p> --><p hidden>no</p><p style='display: none'>no</p></body>", "x y z—q"),
    ("<nav><a href=/>Menu</a></nav><footer>f</footer>", ""),
    ("<noscript>on</noscript>", ""), ("", ""), ("<", "<"), ("a</", "a</"), ("<p", "<p"),
])
def test_page(source, text):
    assert Page(source).text([]) == text


@pytest.mark.parametrize("source", ["<a" * 50_000, "<div>" * 50_000 + "x", '<a title="' * 20_000, "<b>" * 20_000 + "<div>x</div>" * 2_000,
                                    "<!--" * 50_000, "</p>" * 50_000, "<i>" * 50_000 + "<div></div>" * 20_000, "<li><ul>" + "<i>" * 30_000 + "<li></li>" * 20_000, "&amp" * 50_000, "<script>" * 20_000])
def test_hostile_markup_takes_no_long_time(source):
    start = time.perf_counter()
    Page(source).text([])
    assert time.perf_counter() - start < 10


ARTICLE = "<h1>The title</h1><p>" + "Some words of the story. " * 12 + "</p><p>The end of it.</p>"
PLAIN = "The title " + "Some words of the story. " * 12 + "The end of it."
MENU = "<ul class='main-menu'><li><a href=/>Home</a><li>About</ul>"
COMMENTS = "<div id='comments' class='comments-area'><h2>Replies</h2><p>Nice one.</p></div>"


@pytest.mark.parametrize("name", ["layout no-sidebar", "content with-sidebar", "page has-header", "entry has-cookie-banner", "article comments-open",
                                  "main social-enabled", "post tag-newsletter category-share", "theme-copyright", "sidebar-right", "page-header"])
def test_names_that_tell_a_state_do_not_cost_the_article(name):
    assert Page(f"<div class='{name}'>{MENU}<article>{ARTICLE}</article>{COMMENTS}</div>").text([]) == PLAIN
    assert Page(f"<body>{MENU}<div class='{name}'>{ARTICLE}</div>{COMMENTS}<footer>f</footer>").text([]) == PLAIN


@pytest.mark.parametrize("name", ["site-footer", "comment-list", "commentList", "cookie_banner", "nav-links", "widget-area", "share-buttons", "ad-slot", "sidebar"])
def test_names_of_asides(name):
    assert Page(f"<main>{ARTICLE}<div class='x {name} y'><p>not this</p></div></main>").text([]) == PLAIN


@pytest.mark.parametrize("source", [
    f"<form id='aspnetForm'>{MENU}<div>{ARTICLE}</div><button>Send</button></form>",
    f"<article class='post comments-open'>{ARTICLE}</article>{COMMENTS}",
    f"<nav>{'<i>' * 300}<a href=/>Menu</a> and more</nav><main>{'<i>' * 300}{ARTICLE}</main>{'<i>' * 300}{COMMENTS}",
    f"{'<div>' * 400}<article>{ARTICLE}</article><nav>Menu</nav>{COMMENTS}{'</div>' * 400}<footer>f</footer>",
    f"<table><tr><td class=menu>Home<td>{ARTICLE}<tr><td><td class='footer'>f</table>",
    f"<div role=navigation>Home</div><div role=main>{ARTICLE}</div><div role=complementary>side</div>",
    f"<div id=wrapper class='sidebar-left'><div class=sidebar>{'side ' * 9}</div><div id=content>{ARTICLE}</div></div>",
    f"<section><div class='entry-header'></div>{ARTICLE}<div class='related-posts'><article><p>Other</p></article></div></section>",
])
def test_kinds_of_pages(spark, source):
    """By itself, and with a vote of its host."""
    assert Page(source).text([]) == PLAIN
    pages = spark.createDataFrame([(i, "http://h.example/", source) for i in range(5)], SCHEMA)
    assert {r.text for r in extraction.main_text(pages).collect()} == {PLAIN}


def page(pick, n, outer, comments):
    body = " ".join(f"word{pick.randrange(100)}" for _ in range(n))
    remarks = "".join(f"<div class='comment c{i}'><p>{'nice ' * 30}</p></div>" for i in range(comments))
    source = (f"<html><head><title>t</title></head><body><header><a href=/>Site</a></header><ul class=menu><li>Home</ul>"
              f"{outer[0]}<p>{body}</p>{outer[1]}<section id=comments>{remarks}</section><div class=sidebar>{'side ' * 50}</div>"
              f"<footer>&copy; us</footer></body></html>")
    return source, body


def test_host_votes(spark):
    """Short pages follow their host: their own largest container would be the one with the box."""
    pick, rows, expected = random.Random(4), [], {}
    for i in range(40):
        source, body = page(pick, 200, (f"<div class=post-{i}>", "</div><div class=box>" + "box " * 20 + "</div>"), 3)
        rows.append((i, "https://Blog.example.org:80/p", source))
        expected[i] = body
    source, body = page(pick, 12, ("<div class=post-99>", "</div><div class=box>" + "box " * 20 + "</div>"), 2)
    rows.append((40, "http://blog.example.org/short", source))
    expected[40] = body
    source, body = page(pick, 60, ("<main><article>", "</article></main>"), 4)
    rows.append((41, "http://blog.example.org/other", source))
    expected[41] = body
    rows += [(42, None, None), (43, "no host", ""), (44, "http://x.example", "<p>a"), (44, "http://x.example", "<p>a"), (None, None, "<p>b")]
    table = spark.createDataFrame(rows, SCHEMA)
    for name in ("host", "path", "paths", "score", "text", "rank"):
        table = table.withColumn(name, F.lit(1))
    found = extraction.main_text(table)
    assert found.columns == ["page_id", "url", "text"]
    texts = [(r.page_id, r.text) for r in found.collect()]
    assert {i: t for i, t in texts if i is not None and i < 42} == expected
    assert sorted((str(i), t) for i, t in texts if i is None or i > 41) == [("42", ""), ("43", ""), ("44", "a"), ("44", "a"), ("None", "b")]


def test_empty_table(spark):
    assert extraction.main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_host(spark):
    urls = ["https://A.example:80/x", "//b.example?q", "http://u:p@c.example#f", None, "path/only", "", "HTTP://D.example"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in rows.select(extraction.host(F.col("url"))).collect()] == [
        "a.example", "b.example", "c.example", "", "", "", "d.example"]
