"""HTML extraction: blocks, the labeller's gradient, held-out pages, odd markup."""

import html as std
import re
from zlib import crc32

import numpy as np

from millrace.llm import html_labeller as lab
from millrace.llm import html_train as train
from millrace.llm.html_blocks import WORDS, blocks, word_codes
from millrace.llm.html_extract import extract, main_texts


def texts(page):
    return [b.text for b in blocks(page)]


def test_blocks():
    assert texts("<p>a <b>b</b>c<br>d<p>e&amp;f &nbsp; g<div>h<!-- x > y -->i</div>j") == ["a bc d", "e&f g", "hi", "j"]
    assert texts('<script>var t="</p>";</script><style>p{}</style><textarea>no</textarea><p title="a>b">yes</p>') == ["yes"]
    assert texts("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == ["a", "b", "c", "d"]
    assert texts("a < b & c &lt;p&gt; &#233;&#x41; &unknown; &am") == ["a < b & c <p> éA &unknown; &am"]
    assert texts(None) == texts("") == texts("<p></p> \n <div>") == texts("<p unfinished") == []
    assert texts("<p>x</p") == ["x"] and texts("<!-- never closed <p>x") == [] and texts("<script>never closed") == []
    assert [b.path for b in blocks('<div class="post Main-body"><p>a')] == [("div", ".post", ".main", ".body", "p")]
    assert len(texts("<p>" + "x " * 200_000)[0]) == 399_999
    assert len(blocks("<div>" * 3000 + "deep" + "</div>" * 3000)) == 1


def test_long_and_odd_attributes():
    for n in (20_000, 20_001, 1_000_000):
        long = "x>" * (n // 2)
        assert texts(f'<script data-x="{long}">var secret=1;</script><p>a') == ["a"]
        assert texts(f"<p>a<img src='data:{long}' alt=\"{long}\">b") == ["a", "b"]
        assert texts(f'<p title = "{long}" class=x>a</p><div data-y={long.replace(">", "y")}>b') == ["a", "b"]
        assert texts(f"<p>a<svg><path d='{long}'/><text>no</text></svg>b") == ["ab"]
    assert texts('<p title="never closed>a</p><p>b') == ["a", "b"]
    assert texts("<p class=don't>it's a</p><p title='x>y'>b") == ["it's a", "b"]
    assert texts('<a href="x" title="1 > 0">a</a> 2 > 1') == ["a 2 > 1"]
    assert texts('<p a="1"b=\'>\'c>x') == ["x"]
    many = '<a b="' * 100_001  # each closes the one before; the last is open
    assert texts(many + "<p>x") == ["x"] and texts("<p>y</p>" + "<a b='\"" * 50_000 + ">z") == ["y", "z"]


def test_text_of_embedded_elements():
    assert texts("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> be.</p>") == ["Let x=2 be."]
    assert texts("<p>a</p><xmp><b>&amp; b</xmp><p><object data=u>c</object><canvas>d</canvas>") == ["a", "<b>&amp; b", "cd"]


def test_gradient():
    maker, rng = train.Maker(3), np.random.default_rng(0)
    pages = [p for p in (train.labelled(maker.page()) for _ in range(4)) if p[0]]
    x = lab.Input([p[0] for p in pages])
    y = np.zeros((x.steps, x.pages), np.float32)
    for j, (_, marks) in enumerate(pages):
        y[: len(marks), j] = marks
    w = {k: rng.normal(size=v.shape) * 0.2 for k, v in lab.fresh(1).items()}
    _, g = train.gradients(w, x, y)
    for name in w:
        flat = np.flatnonzero(np.abs(g[name].ravel()) > 1e-5)[:3]
        for k in flat:
            losses = []
            for step in (1e-3, -1e-3):
                moved = {**w, name: w[name].copy()}
                moved[name].ravel()[k] += step
                losses.append(train.gradients(moved, x, y)[0])
            assert abs((losses[0] - losses[1]) / 2e-3 - g[name].ravel()[k]) < 2e-3 + 0.05 * abs(g[name].ravel()[k]), name


def test_made_up_pages_not_trained_on():
    maker = train.Maker(991)
    wrong = n = 0
    for _ in range(300):
        found, marks = train.labelled(maker.page())
        if found:
            wrong += int((lab.label([found])[0] != (marks > 0)).sum())
            n += len(found)
    assert wrong / n < 0.01


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">a</a></li><li><a href="/b">b</a></li></ul></nav>'
    '<div class="ad">Buy these now.</div><article><h1>{0}</h1><p>{1}</p><p><b>{2}<br><p>{3}</p></article><footer>&copy; x.example &middot; some words.</footer></body></html>'
)


def test_pages(spark):
    parts = ("The head &amp; more", "One  two\nthree.", "Four", "Five &lt;six&gt; seven eight nine.")
    page = PAGE.format(*parts)
    expected = " ".join(std.unescape(re.sub(r"\s+", " ", " ".join(parts))).split())
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (2, None, None, "y"), (3, "v", "", None), (4, "w", "no markup but words that go on for a while, as text does.", ""), (None, "z", page, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = [(r.page_id, r.text) for r in extract(pages).collect()]
    assert found[:4] == [(1, expected), (1, expected), (2, ""), (3, "")] and found[5] == (None, expected)
    assert extract(pages.limit(0)).count() == 0
    assert main_texts([page] * 300 + [None]) == [expected] * 300 + [""]


def test_all_words_are_read():
    block = blocks("<p>" + "same " * 40 + "other " + "x" * 50)[0]
    assert word_codes(block) == [crc32(w.encode()) % WORDS for w in block.words]
    ends = [blocks("<p>" + "same " * 40 + end)[0] for end in ("cookies", "meadow", "x" * 50)]
    seen = {lab.vectors(lab.trained(), lab.Input([[b]])).tobytes() for b in ends}
    assert len(seen) == 3
