"""Article text against the pages' own markup, marginals against enumeration, odd pages."""

import html
import itertools
import math
import re

import pytest
from pyspark.sql import functions as F

from panelfold.llm import pagetext
from panelfold.llm.queries import QUERIES


def article(page):
    inside = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[a-z/!][^>]*>", "", b)).split())
              for b in re.split(r"</?(?:p|h1|br)[^>]*>", inside)]
    return " ".join(b for b in blocks if b)


def test_query_against_markup(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    found = QUERIES["op9_pagetext"](spark, sf).collect()
    assert len(found) == len(pages)
    for r in found:
        assert r["url"] == pages[r["page_id"]]["url"] and r["n_chars"] == len(r["text"])
        assert r["text"] == article(pages[r["page_id"]]["html"])


@pytest.fixture(scope="module")
def model(spark):
    sf = "/root/testdata/sf0.01"
    from panelfold.llm.urlrules import document_number
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return pagetext.train(pagetext.training_pages(pages, spark.read.parquet(f"{sf}/documents.parquet"), document_number()))


def test_marginals_against_all_states(model):
    nodes = pagetext.parse("<body><nav><a href=x>one</a></nav><div class=ad>buy it</div><article><p>A longer text, it is."
                           "</p></article></body>")
    weight = [sum(model.odds.get(f, 0.0) for f in pagetext.features(n)) for n in nodes]
    place = {id(n): i for i, n in enumerate(nodes)}
    total, on = 0.0, [0.0] * len(nodes)
    for states in itertools.product((0, 1), repeat=len(nodes)):
        score = sum(w for w, s in zip(weight, states) if s)
        score += sum(model.turn[states[place[id(n.parent)]]][s] for n, s in zip(nodes[1:], states[1:]))
        p = math.exp(score)
        total += p
        for i, s in enumerate(states):
            on[i] += p * s
    for got, want in zip(model.marginals(nodes), on):
        assert abs(got - want / total) < 1e-9


PAGE = """<!doctype html><html><head><title>No title</title><style>p{}</style></head><body>
<header class="site-header"><h2>Site name</h2><ul><li><a href=/>Home</a><li><a href=/a>About us</a></ul></header>
<div id="cookie-notice">We use cookies on this site, please accept them.</div>
<form><label>Your mail</label><input><button>Send it</button></form>
<main><article><h1>A &amp; B</h1><p>First <b>bold</b>text &lt;here&gt;,
  with a line.<p>Second paragraph has some more words in it.<ul><li>An item of a list in the text.</ul>
<div class="advert">Buy this thing now, it is cheap and good.</div>
<pre>code  block
here</pre><script>var x = "<p>no</p>";</script><!-- a <p>comment</p> --></article></main>
<aside class="sidebar">Popular posts of this week are shown here.</aside>
<section id="comments"><p>Nice post, thank you for this.</p><div class="comment">I do not agree at all with it.</div></section>
<footer>&copy; 2024 Site name. All rights reserved.</footer></body></html>"""
WANTED = ("A & B First boldtext <here>, with a line. Second paragraph has some more words in it. "
          "An item of a list in the text. code block here")


def test_parts_that_are_not_the_article(model):
    assert model.text(PAGE) == WANTED
    bare = pagetext.TreeModel({})  # no labelled pages at all
    assert bare.text(PAGE) == WANTED


def test_odd_pages(spark, model):
    texts = [None, "", "plain text without tags, that is all.", "<", "<p", "<p>unclosed &am", "</p></div>", "<!-- open",
             "<script>never closed <p>x</p>", "<p a=\"open>text</p>", "<article>" + "<p>word here.</p>" * 3000 + "</article>",
             "<div>" * 3000 + "deep text lies here, in a box." + "</div>" * 3000, "<article><p>same</p></article>"]
    pages = spark.createDataFrame([(i, f"u{i}", t) for i, t in enumerate(texts)] + [(12, None, texts[12]), (None, "u", texts[12])],
                                  "page_id bigint, url string, html string").withColumn("text", F.lit(1)).withColumn("f", F.lit(1))
    found = pagetext.extract(pages, model).collect()
    assert len(found) == len(texts) + 2
    got = {r["page_id"]: r["text"] for r in found}
    assert got[0] == got[1] == "" and got[10] == " ".join(["word here."] * 3000) and got[None] == got[12] == "same"
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    assert pagetext.extract(pages.limit(0), model).count() == 0
    none = pagetext.train(pages.limit(0).select("html", F.lit("x").alias("text")))
    assert none.text(PAGE) == WANTED


def test_damaged_pages_take_linear_time():
    import time
    for page in ("<a " * 350_000, "<div>" * 100_000 + "</zz>" * 100_000, "<b>x" * 250_000,
                 "<p>shown</p>" + "<a " * 300_000 + "<!-- hidden"):
        start = time.perf_counter()
        nodes = pagetext.parse(page)
        assert time.perf_counter() - start < 15
        assert not any(n.text and "hidden" in n.text for n in nodes)


def test_all_class_names_of_an_element_count():
    node = pagetext.Node("div", None, tuple(f"name{chr(97 + k)}" for k in range(20)))
    assert sum(f.startswith("class:") for f in pagetext.features(node)) == 20
