"""Main text: blocks of odd pages, held-out pages, and the pages table."""

import re

import numpy as np
import pytest

from codestrata.llm import html_crf, html_pages
from codestrata.llm.html_blocks import blocks

PAGES = {
    "<p>a<p>b": ["a", "b"],
    "<p>a<b>b</b> c<br>d &amp; &#233;&nbsp;&lt;x&gt;</p>": ["ab c d & é <x>"],
    "x<!-- <p>no</p> --><script>var a='<p>';</script><style>p{}</style>y": ["xy"],
    "<ul><li>a<li>b</ul>c": ["a", "b", "c"],
    "<table><tr><td>a<td>b<tr><th>c</table>": ["a", "b", "c"],
    "<div>a<div>b</div>c</div></div></p>d": ["a", "b", "c", "d"],
    "<title>a <b> c</title><textarea>x</textarea>": ["a <b> c", "x"],
    "a < b > c <": ["a < b > c <"],
    "<p title='a > b' class=x>ok</p>": ["ok"],
    "<script>never ends <p>x": [],
    "<!-- never ends <p>x": [],
    "<p": [],
    '<p class="x>Hello</p>': ["Hello"],
    "<p class='x>Hello</p><p>there": ["Hello", "there"],
    "<p title=it's>Don't</p>": ["Don't"],
    '<p class = "a>b" id=\'c">d\'>x "y" </p>': ['x "y"'],
    "one<xmp><b>two</b> &amp;</xmp>three": ["one", "<b>two</b> &amp;", "three"],
    "<p>a<noembed> b </noembed>c</p><noframes><p>d</p></noframes>e": ["a b c", "d", "e"],
    "": [],
    "<dl><dt>a<dd>b<dt>c</dl>": ["a", "b", "c"],
    "<P>A\n\t  B</P>": ["A B"],
    "<p><b>head<br><p>text</p>": ["head", "text"],
}


@pytest.mark.parametrize("source", PAGES)
def test_blocks(source):
    assert [b.text for b in blocks(source)] == PAGES[source]


def test_what_is_around_a_block():
    b = blocks('<article class="post Main-1"><div id=x><p>a <a href=b>link</a></p></div></article><p>c')
    assert {"article", ".post", ".main", "div", ".x", "p"} <= b[0].around and b[0].in_links == 4 and b[0].tag == "p"
    assert "article" not in b[1].around


def test_deep_and_long_pages_take_linear_time():
    assert len(blocks("<div>" * 20_000 + "x" + "</div>" * 20_000)) == 1
    assert len(blocks("<p>a" * 20_000)) == 20_000
    assert len(blocks("<" * 50_000)) == 1
    assert len(blocks("<a =\"" * 20_000 + ">x")) == 1
    assert len(blocks("<a ='>x" * 10_001)) == 1


@pytest.fixture(scope="module")
def model():
    return html_crf.default_model()


def test_held_out_pages(model):
    pages = [html_crf.marked(s) for s in html_pages.labelled(300, seed=12345)]
    got = model.decode([p for p, _ in pages])
    right = [(a == b).mean() for a, (_, b) in zip(got, pages, strict=True) if len(b)]
    assert np.mean(right) > 0.985


A = "The river rose slowly during the night, and by morning the lower fields were under water."
B = "Nobody in the village had seen such a flood before, although the old books speak of three."
C = "Repairs will take until spring, the council said, if the weather allows it."
H = "A flood in the valley"
OTHER_LAYOUTS = {
    "table": (f"<html><body bgcolor=white><table><tr><td colspan=2><a href=/>Home</a> | <a href=/news>News</a> | <a href=/about>About</a></td></tr><tr><td width=150><a href=1>One</a><br><a href=2>Two</a></td><td><h2>{H}</h2><p>{A}<p>{B}<p>{C}</td></tr><tr><td colspan=2>Copyright 2001 Valley News</td></tr></table></body></html>", [H, A, B, C]),
    "role": (f"<body><div role=banner><h1>Valley News</h1></div><div role=navigation><ul><li><a href=a>World</a><li><a href=b>Sport</a></ul></div><div role=main><h1>{H}</h1><div><p>{A}</p><p>{B}</p></div><ul><li>{C}</li></ul></div><div role=contentinfo>Contact us</div></body>", [H, A, B, C]),
    "deep": (f"<div id=wrapper><div class=top-nav><a href=1>Log in</a> <a href=2>Sign up</a></div><div class=columns><div class=column-left><section><header><h1>{H}</h1></header><p>{A}</p><figure><img src=x><figcaption>The river on Sunday.</figcaption></figure><p>{B}</p><blockquote>{C}</blockquote></section><ol class=commentlist><li>First!</li><li>I saw it too, it was awful.</li></ol></div><div class=column-right><h3>Most read</h3><ul><li><a href=z>Cat found</a></li></ul></div></div><div class=site-footer>All rights reserved</div></div>", [H, A, "The river on Sunday.", B, C]),
    "cookie": (f"<body><div class=cookie-banner><p>We use cookies to improve your visit. Read our policy to learn more about it.</p><button>Accept</button></div><main><article><header><h1>{H}</h1></header><p>{A}</p><aside class=related><a href=q>Related: another flood</a></aside><p>{B}</p><p>{C}</p><footer>Tags: <a href=t>water</a></footer></article><section id=comments><h2>2 comments</h2><p>Terrible news for everyone who lives there and for the farms.</p></section></main><footer><p>&copy; Valley News</p></footer></body>", [H, A, B, C]),
}


@pytest.mark.parametrize("name", OTHER_LAYOUTS)
def test_pages_that_no_rule_laid_out(model, name):
    source, expected = OTHER_LAYOUTS[name]
    page = blocks(source)
    assert [b.text for b, y in zip(page, model.decode([page])[0], strict=True) if y] == expected


def test_viterbi_finds_the_best_labels(model):
    pages = [html_crf.marked(s)[0][:9] for s in html_pages.labelled(25, seed=5)] + [[]]
    for page, got in zip(pages, model.decode(pages), strict=True):
        scores = model.unary(page)

        def total(labels, scores=scores):
            return sum(scores[t][y] for t, y in enumerate(labels)) + sum(model.transition[a, b] for a, b in zip(labels, labels[1:], strict=False)) + (model.begin[labels[0]] if labels else 0)

        best = max(total([k >> t & 1 for t in range(len(page))]) for k in range(1 << len(page)))
        assert total(got.tolist()) == pytest.approx(best)


def test_training_learns_more_than_the_prior():
    sources = html_pages.labelled(60, seed=8)
    model = html_crf.train(sources, passes=40)
    pages = [html_crf.marked(s) for s in html_pages.labelled(60, seed=9)]
    got = np.concatenate(model.decode([p for p, _ in pages]))
    truth = np.concatenate([y for _, y in pages])
    assert (got == truth).mean() > max(truth.mean(), 1 - truth.mean()) + 0.1


def article_of(source):
    """The table's pages bear their article in one element, whose paragraphs and headings are its blocks."""
    inner = re.search(r"<article>(.*)</article>", source, re.S)[1]
    import html

    parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner.replace("<br>", " ")))
    return "\n\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)


def test_the_pages_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.id: r for r in html_crf.extract(rows).collect()}
    for r in rows.collect():
        assert got[r.page_id].text == article_of(r.html)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_awkward_pages(spark):
    rows = spark.createDataFrame([(1, "u", None, "x"), (1, None, "", "x"), (None, "u", "<p>", "x"), (2, "u", "<article><p>A sentence of some words, long enough to be read.</p></article>", "x")], "page_id long, url string, html string, text string")
    got = html_crf.extract(rows).collect()
    assert len(got) == 4 and [r.text for r in got if r.id == 2] == ["A sentence of some words, long enough to be read."]
    assert {(r.text, r.n_chars) for r in got if r.id != 2} == {("", 0)}
    assert html_crf.extract(rows.limit(0)).count() == 0
