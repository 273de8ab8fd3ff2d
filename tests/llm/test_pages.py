"""Extraction: what templates may not take away."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.llm import pages
from quillspark.llm.runtime import Scratch

PLAIN = "<html><body><div class='top'>Our site</div><div class='box'><h1>{0}</h1><p>{0} goes on</p></div><div class='low'>Write to us</div><script>track({1})</script></body></html>"


def texts(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in pages.extract(df, Scratch(spark, "t")).collect()}


def test_copies_are_not_template(spark):
    rows = [(k, f"http://few.example/{k}", PLAIN.format("the copied story", k)) for k in range(2)] + [(2, "http://few.example/2", PLAIN.format("another", 2))]
    rows += [(k, f"http://hot.example/{k}", PLAIN.format("the copied story", k)) for k in range(10, 40)] + [(k, f"http://hot.example/{k}", PLAIN.format(f"story {k}", k)) for k in range(40, 45)]
    got = texts(spark, rows)
    assert all("the copied story goes on" in got[k] for k in range(2)) and "another goes on" in got[2]
    assert all(got[k] == "the copied story\n\nthe copied story goes on" for k in range(10, 40))
    assert all(got[k] == f"story {k}\n\nstory {k} goes on" for k in range(40, 45))


def test_pages_without_host_share_no_template(spark):
    rows = [(k, url, PLAIN.format(f"story {k}", k)) for k, url in enumerate([None, "x", "/a/b", "a.html", None])]
    assert all(text.startswith("Our site") and f"story {k} goes on" in text for k, text in texts(spark, rows).items())
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", pages.host(F.col("url")))
    assert pages.templates(df, Scratch(spark, "t")).count() == 0


def test_template_within_the_main_part(spark):
    page = "<html><body><article><h1>Story {0}</h1><p>What happened in story {0} is told at some length here.</p><div><p>Prices include taxes.</p></div></article></body></html>"
    got = texts(spark, [(k, f"http://h.example/{k}", page.format(k)) for k in range(6)])
    assert got == {k: f"Story {k}\n\nWhat happened in story {k} is told at some length here." for k in range(6)}
    edited = "<html><body><article><h1>The story</h1><p>What happened is told at some length here.</p><p>Edit {0}</p></article></body></html>"
    got = texts(spark, [(k, f"http://h.example/{k}", edited.format(k)) for k in range(6)])
    assert got == {k: f"The story\n\nWhat happened is told at some length here.\n\nEdit {k}" for k in range(6)}


def test_names_of_wrappers():
    body = "<h1>Head</h1><p>What the page says.</p>"
    none = frozenset()
    for wrapped in (
        f"<article class='post no-comments'>{body}</article>",
        f"<div class='content has-sidebar'><article>{body}</article></div>",
        f"<div class='page-with-header'>{body}</div>",
        f"<div class='search'><main>{body}</main></div>",
        f"<div class='alert'><article class='related'>{body}</article></div>",
        "<article><div class='entry-header'><h1>Head</h1></div><p>What the page says.</p></article>",
        f"<article><div class='share'>{body}</div></article>",
        f"<div class='widget'>{body}</div><div class='ad'>buy</div>",
    ):
        assert pages.main_text(f"<html><body><nav>menu</nav>{wrapped}<footer>foot</footer></body></html>", none) == "Head\n\nWhat the page says.", wrapped


def test_names_that_still_decide():
    none = frozenset()
    replies = "<div class='comments'><article class='comment'>one says this at length, at length</article><article class='comment'>two says that at length, at length</article></div>"
    assert pages.main_text(f"<p>Story</p>{replies}", none) == "Story"
    assert pages.main_text(f"<article><p>Story</p>{replies}</article>", none) == "Story"
    assert pages.main_text("<article><p>Story of some length</p></article><div class='related'><article>teaser</article></div><span class='ad'>buy <span>now</span></span>", none) == "Story of some length"
    assert pages.main_text("<p>Story of some length</p><div class='ad-slot'>buy</div><div class='site-header'>Site</div><div id='cookie-notice'>Take</div>", none) == "Story of some length"


def test_quotes_open_values_only():
    none = frozenset()
    for tag in ("data-t=it's", "it's", "data-t='a>b'", 'title="a > b" x', "a=b=c'd", "'", '"', "a = 'x' b", "class=x/", "=''"):
        page = f"<article><h1>Head</h1><p {tag}>Hello world</p><p>Two</p></article>"
        assert pages.main_text(page, none) == "Head\n\nHello world\n\nTwo", tag
    assert pages.main_text("<p>One</p><p title='never closed>Two</p>", none) == "One"
    assert pages.main_text("<p>One</p><p it's", none) == "One" and pages.main_text("<p>One</p><p a=\"", none) == "One"
    assert pages.main_text("<p title='class=ad'>One</p><p class=ad>Two</p><p CLASS = 'ad'>Three</p>", none) == "One"
    long = "<article>" + "<p title=\"it's\" data-x=it's>said</p>" * 30_000 + "</article>"
    assert pages.main_text(long, none).count("said") == 30_000
    assert pages.main_text("<p " + "a='b' " * 100_000 + "c", none) == ""


def test_wrappers_headers_and_teasers():
    none = frozenset()
    story = "<h1>Head</h1><p>The whole story is told here at some length.</p>"
    whole = "Head\n\nThe whole story is told here at some length."
    for wrapped in (f"<form id='aspnetForm'><div><article>{story}</article></div></form>", f"<form><div>{story}</div><input></form>", f"<form><fieldset>{story}</fieldset></form>", f"<dialog open>{story}</dialog>", f"<article><header><h1>Head</h1></header>{story[13:]}</article>"):
        assert pages.main_text(f"<body><nav>menu</nav>{wrapped}<footer>foot</footer></body>", none) == whole, wrapped
    assert pages.main_text(f"<div>{story}</div><form><label>Your name and address</label><input></form>", none) == whole
    assert pages.main_text("<div>Short.</div><form><p>Subscribe here.</p></form>", none) == "Short."
    assert pages.main_text(f"<header>Site</header><article>{story}</article>", none) == whole
    assert "The whole story" in pages.main_text(f"<div>{story}</div><article><a>teaser</a></article>", none)
