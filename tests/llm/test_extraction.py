"""Blocks of pages, the recurrent labeller's gradients and held-out accuracy, and the main text of the given pages."""

import html
import re

import numpy as np
import pytest
from plain import SMALL

from fleetpulse.llm import extraction, recurrent
from fleetpulse.llm.blocks import Block, blocks_of
from fleetpulse.llm.queries import QUERIES

LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def weights():
    return extraction.fit([])


def texts(page):
    return [b.text for b in blocks_of(page)]


@pytest.mark.parametrize(
    "page, expected",
    [
        (None, []),
        ("", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("<p>a<p>b</p>c", ["a", "b", "c"]),
        ("<p><b>bold<br><p>next", ["bold", "next"]),
        ("<p>one<br>two <i>th</i>ree\n\t four&nbsp;</p>", ["one two three four"]),
        ('<script>var t="</p>";</script><style>p{}</style><!-- <p>x --><p>y', ["y"]),
        ("<title>t</title><textarea>typed</textarea><p>x", ["x"]),
        ("<p>a<script>never closed <p>b", ["a"]),
        ("<p>a<!-- never closed <p>b", ["a"]),
        ("a < b and <3 but <p title='x>y'>c", ["a < b and <3 but", "c"]),
        ('<p class="x>open</p>q', ["open", "q"]),
        ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("</div></p>x</article>", ["x"]),
        ("<P>Up</P><DIV>per", ["Up", "per"]),
        ("<!DOCTYPE html><?xml?><p>&#39;&lt;p&gt;&eacute;&bogus;", ["'<p>é&bogus;"]),
    ],
)
def test_blocks(page, expected):
    assert texts(page) == expected


def test_paths_and_links():
    page = '<body><div class="Side-bar topLinks" id=x1><ul><li><a href=u>All</a><li>Half <a>link</a></ul></div><article><p>T'
    found = blocks_of(page)
    assert [(b.text, b.linked) for b in found] == [("All", 3), ("Half link", 4), ("T", 0)]
    assert found[0].path == [("body",), ("div", "side", "bar", "top", "links", "x", "1"), ("ul",), ("li",)]
    assert found[1].path[-1] == ("li",) and found[2].path == [("body",), ("article",), ("p",)]


def test_long_and_deep_pages_are_scanned_in_linear_time():
    assert texts("<div>" * 200_000 + "x" + "</p>" * 200_000) == ["x"]
    assert len(texts("<p>word " * 200_000)) == 200_000
    assert texts("<" * 300_000) == ["<" * 300_000]
    assert len(texts("<li>a" * 50_000 + "</ul>" * 50_000)) == 50_000


def test_gradients():
    rng = np.random.default_rng(2)
    params = recurrent.initial(rng, {"path": (8, 3), "word": (8, 2)}, extraction.DENSE, 3)
    maker = extraction.PageMaker([], 1)
    pages = [[Block(*b[:3]) for b in p[:5]] for p in (maker.page() for _ in range(4)) if p]
    batch = extraction.batch_of(pages)
    batch.ids = {k: (ids % 8, bounds) for k, (ids, bounds) in batch.ids.items()}
    labels = rng.integers(0, 2, batch.seq.size).astype(float)
    _, grads = recurrent.gradients(params, batch, labels)
    for name, value in params.items():
        for at in rng.integers(0, value.size, 4):
            losses = []
            for step in (1e-5, -1e-5):
                moved = {**params, name: value.copy()}
                moved[name].flat[at] += step
                losses.append(recurrent.gradients(moved, batch, labels)[0])
            assert (losses[0] - losses[1]) / 2e-5 == pytest.approx(grads[name].flat[at], abs=1e-6), name


def test_held_out_accuracy(weights):
    maker = extraction.PageMaker([], 1234)
    made = [p for p in (maker.page() for _ in range(300)) if p]
    found = extraction.labels_of(weights, [[Block(*b[:3]) for b in p] for p in made])
    truth = np.array([b[3] == 1 for p in made for b in p])
    assert np.mean(np.concatenate(found) == truth) > 0.97


def test_labels_do_not_depend_on_neighbouring_pages(weights):
    maker = extraction.PageMaker([], 5)
    pages = [[Block(*b[:3]) for b in maker.page()] for _ in range(40)] + [[]]
    together = extraction.labels_of(weights, pages)
    assert all(np.array_equal(extraction.labels_of(weights, [p])[0], t) for p, t in zip(pages, together))


def test_other_layouts(spark, weights):
    said = "The council met on Tuesday to settle the budget for the coming year, and members agreed."
    pages = [
        f'<header class="site"><a href="/">Daily</a></header><div id="content" class="post"><h1>Title</h1><p>{said}</p><p>{said} Twice.</p></div>'
        f'<div class="sidebar"><ul><li><a>Related</a></ul></div><section id="comments"><p>{said} Not mine.</p></section><footer>&copy; Daily</footer>',
        f'<nav><a>Home</a></nav><main><h1>Title</h1><p>{said}</p><aside class="ad">Buy now</aside><p>{said} Twice.</p></main>'
        '<form class="newsletter">Subscribe<input><button>Send</button></form><div class="cookie-banner">We use cookies.</div>',
    ]
    docs = spark.createDataFrame([(i, None, p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    for row in extraction.extract(docs, weights).collect():
        assert row.text == f"Title\n{said}\n{said} Twice.", row.page_id


def plain_text(page):
    """Blocks of the given pages' one layout: headings and paragraphs within the article."""
    main = re.search(r"<article>(.*)</article>", page, re.S)
    pieces = re.split(r"</?(?:p|h1)>", main[1]) if main else []
    lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p) if "<br>" in p else re.sub(r"<[^>]*>", "", p)).split()) for p in pieces]
    return "\n".join(x for x in lines if x)


@pytest.mark.parametrize("directory", [SMALL, LARGER])
def test_query(spark, directory):
    given = {r.page_id: r for r in spark.read.parquet(f"{directory}/pages.parquet").collect()}
    found = QUERIES["op12_html_extraction"](spark, directory).collect()
    assert len(found) == len(given)
    for row in found:
        assert (row.url, row.text, row.n_chars) == (given[row.page_id].url, plain_text(given[row.page_id].html), len(row.text))


def test_odd_rows(spark, weights):
    long = "<article>" + "<p>One more line of the story, told at length.</p>" * 30_000 + "</article>"
    rows = [(1, None, None), (None, "u", ""), (2, "u", "<nav><a>x</a></nav>"), (3, "u", long), (3, "u", long)]
    docs = spark.createDataFrame([(*r, "?", "?") for r in rows], "page_id long, url string, html string, text string, n_chars string")
    found = sorted(extraction.extract(docs, weights).collect(), key=str)
    by_id = {r.page_id: (r.text, r.n_chars) for r in found}
    assert len(found) == 5 and by_id[1] == by_id[None] == by_id[2] == ("", 0)
    assert by_id[3][0].count("\n") == 29_999
    assert extraction.extract(docs.where("false")).collect() == []
