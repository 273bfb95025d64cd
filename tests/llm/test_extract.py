import itertools
import re
from html import unescape

import numpy as np
import pytest

from waymark.llm import extract
from waymark.llm.dom import blocks
from waymark.llm.queries import QUERIES


@pytest.fixture(scope="module")
def field():
    return extract.default_field()


def test_pages_of_other_authors(field):
    author = extract.Author(99)
    right = wrong = missed = exact = 0
    for _ in range(300):
        page, labels, text = extract.labelled(author.page())
        got = field.decode(extract.features(page))
        for b, y, g in zip(page, labels, got):
            right += len(b.text) * (y and g)
            wrong += len(b.text) * (g and not y)
            missed += len(b.text) * (y and not g)
        exact += got == labels
    print("precision", right / (right + wrong), "recall", right / (right + missed), "whole pages", exact / 300)
    assert right / (right + wrong) > 0.985 and right / (right + missed) > 0.985 and exact > 240


def test_whole_table_against_its_markup(spark, sf):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op6_main_text"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inside = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]]["html"], re.S)[1]
        want = " ".join(unescape(re.sub(r"<(?:/?(?:h1|p)|br)[^>]*>", " ", inside).replace("<b>", "").replace("</b>", "")).split())
        assert r["text"] == want and r["n_chars"] == len(want) and r["url"] == pages[r["page_id"]]["url"]


def test_blocks_of_odd_markup():
    text = lambda html: [b.text for b in blocks(html)]
    assert text("") == [] and text("just  text") == ["just text"] and text("a &lt;b&gt; &#233;&nbsp;x") == ["a <b> é x"]
    assert text('<script>var t="</p>";</script><p>x<style>p{}</style>y</p>') == ["x", "y"]
    assert text("<p>one<p>two<b>bo</b>ld<br>three") == ["one", "twobold", "three"]
    assert text("<ul><li>a<li>b<ul><li>c</ul></ul>d") == ["a", "b", "c", "d"]
    assert text("<p>cut off <a href='x") == ["cut off"]
    assert [(b.text, b.hidden) for b in blocks("<!-- c --><p hidden>a</p><div style='display:none'><p>b</p></div>yes 1 < 2")] == [("a", True), ("b", True), ("yes 1 < 2", False)]
    assert text("<p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> said <svg><text>x</text></svg>they</p>") == ["Energy is E=m said xthey"]
    assert text("<noscript>on</noscript><iframe>in &amp;</iframe><textarea>f &amp;</textarea><template>t</template>") == ["on", "in &amp;", "f &"]
    assert blocks("<nav><a>in</a> out</nav>")[0].linked == 2
    assert len(blocks("<div>" * 50_000 + "deep")) == 1


STORY = "<h1>A title of it</h1><p>Long enough text, with words in it. Energy is <math><mi>E</mi><mo>=</mo><mi>mc</mi></math>, said they.</p><p>And then more of it, as it goes on.</p>"


@pytest.mark.parametrize("page", [
    "<body style='visibility:hidden'><nav><a href='/'>Home</a></nav><article>{}</article><footer>&copy; x</footer></body>",
    "<body hidden><nav><a href='/'>Home</a></nav><main>{}</main></body>",
    "<body><div class='cookie-notice' hidden>We use cookies, accept them.</div><article style='display: none'>{}</article></body>",
])
def test_hidden_and_formulas(field, page):
    assert extract.main_text(page.format(STORY), field) == "A title of it Long enough text, with words in it. Energy is E=mc, said they. And then more of it, as it goes on."


def test_decode_is_the_best_of_all_labellings():
    rng = np.random.default_rng(8)
    for _ in range(60):
        model = extract.Field(rng.normal(size=6), rng.normal(size=(2, 2)), rng.normal(size=2))
        rows = [sorted(rng.choice(6, rng.integers(1, 4), replace=False).tolist()) for _ in range(rng.integers(1, 8))]

        def score(labels):
            total = model.start[labels[0]] + sum(model.weights[r].sum() for r, y in zip(rows, labels) if y)
            return total + sum(model.moves[a, b] for a, b in zip(labels, labels[1:]))

        best = max(itertools.product((0, 1), repeat=len(rows)), key=score)
        assert abs(score(model.decode(rows)) - score(best)) < 1e-9


def test_edges(spark, field):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><h1>T</h1><p>Long enough text, with words in it.</p></article><footer>&copy; x</footer>"), (3, "v", "<nav><a>x</a></nav>"), (3, "v", "<nav><a>x</a></nav>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = sorted((tuple(r) for r in extract.main_texts(pages, field).collect()), key=str)
    assert got == sorted([(1, "u", "", 0), (2, None, "", 0), (None, "u", "T Long enough text, with words in it.", 37), (3, "v", "", 0), (3, "v", "", 0)], key=str)
    assert extract.main_texts(pages.where("page_id > 9"), field).collect() == []
