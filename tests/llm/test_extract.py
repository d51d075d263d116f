"""Page extraction: blocks of broken markup, the field against enumeration, held-out accuracy, whole queries."""

import html
import itertools
import re
import time

import numpy as np
import pytest
from test_ops import SF

from tiepoint.llm import dom, extract, storage

LONG = "A sentence that tells something, with commas and all. And another one follows it here."


def texts(page):
    return [b.text for b in dom.blocks(page)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []),
        ("plain &amp; simple &lt;p&gt; &copy", ["plain & simple <p> ©"]),
        ("<p>one<p>two <b>bold</p>rest", ["one", "two bold", "rest"]),
        ("<p><b>text.<br><p>next\n \t line</p>", ["text.", "next line"]),
        ("<div>a<div>b</div>c</div></div>d", ["a", "b", "c", "d"]),
        ("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>x", ["1", "2", "3", "4", "x"]),
        ("<table><tr><td>a<td>b<tr><th>c<p>d<tbody><td>e</table>f", ["a", "b", "c", "d", "e", "f"]),
        ("<dl><dt>a<dd>b<dt>c</dl>", ["a", "b", "c"]),
        ("a<script>var x='<p>no</p>';</script>b<style>p{}</style>c<!-- <p>no</p> -->d", ["abcd"]),
        ("<title>t &amp; u</title><body>x<textarea><p>y</textarea>", ["x"]),
        ("a<script>never closed <p>b", ["a"]),
        ("a<!-- never closed <p>b", ["a"]),
        ("a < b <3 c<", ["a < b <3 c<"]),
        ("<a href='x>y'>in</a> out<p title=\"a>b\">c", ["in out", "c"]),
        ("<p class=\"open>one<p>two", ["one", "two"]),
        ("<select><option>a<option>b</select>c<noscript>d<p>e</noscript>f", ["cf"]),
        ("x<svg/>y<svg><text>z</text></svg>", ["xy"]),
        ("<button>Press</button>text", ["Press", "text"]),
        ("</p></div></a>text<", ["text<"]),
        ("&am &quo &amp &#x41;&#66; &nosuch;", ["&am &quo & AB &nosuch;"]),
        ("<p>tag that never ends <p", ["tag that never ends"]),
        ("<?xml version='1'?><!DOCTYPE html><p>x", ["x"]),
        ("<p>a<hr>b<h1>c<h2>d", ["a", "b", "c", "d"]),
    ],
)
def test_blocks(page, want):
    assert texts(page) == want


def test_marks_of_blocks():
    page = "<article class='post-body'><p>a <a href=x>link</a></p><aside id=relatedLinks><p>b</p></aside></article><div style='display: none'>c</div>"
    a, b, c = dom.blocks(page)
    has = lambda block, name: bool(block.marks >> [*dom.TAGS, *dom.NAMES].index(name) & 1)
    assert has(a, "article") and has(a, "content") and has(a, "p") and not has(a, "aside") and (a.near, a.linked) == (1, 4)
    assert has(b, "aside") and has(b, "article") and b.near == 2
    assert has(c, "hidden") and not has(c, "article")


@pytest.mark.parametrize(
    "page",
    ["<div>" * 200_000, "<div></p>" * 100_000, "<b>" * 100_000 + "</i></b>" * 100_000, "<b>" * 50_000 + "<div></b>" * 50_000, "<p>x" * 200_000, "<!--" * 200_000, "<a b=\"" * 100_000, "<script>" * 100_000, "<" * 500_000, "<a<a" * 200_000, "<li><ul>" * 100_000, "&" * 500_000, "<a>" * 100_000],
    ids=range(13),
)
def test_reading_is_linear(page):
    begun = time.perf_counter()
    dom.blocks(page)
    assert time.perf_counter() - begun < 20


def test_field_equals_enumeration():
    rnd = np.random.default_rng(2)
    scores, steps = rnd.normal(size=(4, 6)), rnd.normal(size=(2, 2))
    sizes = [6, 1, 3, 5]
    mask = np.asarray([[t < n for t in range(6)] for n in sizes])
    scores = np.where(mask, scores, 0)
    total, likely, pairs = extract._sums(scores, mask, steps)
    want_pairs = np.zeros((2, 2))
    for k, n in enumerate(sizes):
        paths = [*itertools.product((0, 1), repeat=n)]
        value = [sum(y * scores[k, t] for t, y in enumerate(p)) + sum(steps[a, b] for a, b in itertools.pairwise(p)) for p in paths]
        z = np.logaddexp.reduce(value)
        assert np.isclose(total[k], z)
        for t in range(n):
            assert np.isclose(likely[k, t], sum(np.exp(v - z) for p, v in zip(paths, value, strict=True) if p[t]))
        for p, v in zip(paths, value, strict=True):
            for a, b in itertools.pairwise(p):
                want_pairs[a, b] += np.exp(v - z)
        assert not likely[k, n:].any()
    assert np.allclose(pairs, want_pairs)


def test_decoding_equals_enumeration():
    rnd = np.random.default_rng(5)
    page = dom.blocks("".join(f"<p>{LONG if k % 3 else 'x'}</p><li><a>y{k}</a>" for k in range(4)))
    scores = np.concatenate([*extract.features(page)])
    for _ in range(50):
        field = extract.Field(rnd.normal(size=extract.FEATURES), rnd.normal(size=(2, 2)))
        value = lambda p: sum(y * s for y, s in zip(p, scores @ field.weights, strict=True)) + sum(field.steps[a, b] for a, b in itertools.pairwise(p))  # noqa: B023,E731
        best = max(itertools.product((0, 1), repeat=len(page)), key=value)
        assert field.decode(page) == [*map(bool, best)]
    assert field.decode([]) == []


def test_training_follows_the_gradient():
    """A small field learns labels that depend on the block before."""
    rnd = np.random.default_rng(1)
    pages = []
    for _ in range(60):
        x = np.zeros((12, extract.FEATURES), np.float32)
        x[:, 0], x[:, -1] = rnd.random(12) < 0.3, 1
        y = np.zeros(12)
        for t in range(12):
            y[t] = 1 if x[t, 0] else (y[t - 1] if t else 0)
        pages.append((x, y))
    field = extract.fit(pages)
    assert field.steps[1, 1] + field.steps[0, 0] > field.steps[0, 1] + field.steps[1, 0] and field.weights[0] > 2


def test_held_out_accuracy_on_built_pages():
    field = extract.built_in()
    right = blocks = 0
    for page, text in extract.labelled_pages(200, seed=99):
        found = dom.blocks(page)
        right += int((extract.labels(found, text) == np.asarray(field.decode(found))).sum())
        blocks += len(found)
    assert right > 0.985 * blocks


def test_other_layouts():
    field = extract.built_in()
    page = (
        f"<div id=wrapper><div class=topbar><a href=/>Home</a></div><div class='post-content'><h1>Title</h1><p>{LONG}</p><p>Short.</p>"
        f"<div class=related-posts><h3>More</h3><ul><li><a href=1>one</a><li><a href=2>two</a></ul></div><p>{LONG}</p><ul><li>First item.</li></ul></div>"
        f"<div id=comments><h3>2 comments</h3><div class=comment><p>{LONG}</p></div><form><button>Send</button></form></div><div class=sidebar><p>{LONG}</p></div></div><div id=footer><p>© 2020</p></div>"
    )
    assert extract.main_text(page, field) == f"Title\n{LONG}\nShort.\n{LONG}\nFirst item."
    page = (
        f"<header><nav><ul><li><a>A</a></ul></nav></header><div class=cookie-consent>We use cookies to make it better. <button>OK</button></div><main><article><header><h1>Title</h1></header>"
        f"<p>{LONG}</p><aside class=newsletter><p>Sign up for our letter, it is free.</p></aside><p>{LONG}<section class=comments><article class=comment><p>{LONG}</p></article></section></article></main><footer>x</footer>"
    )
    assert extract.main_text(page, field) == f"Title\n{LONG}\n{LONG}"


def brute(page):
    """The text of a page of the tables' layout."""
    inside = re.search("<article>(.*)</article>", page, re.S)[1]
    parts = re.split("</?(?:p|h1)>", re.sub("<br>", " ", inside.replace("<b>", "")))
    return "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_op12_query(spark, sf):
    folder = SF.replace("sf0.001", sf)
    pages = {r.page_id: r for r in storage.table(spark, folder, "pages").collect()}
    got = extract.op12(spark, folder).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, brute(pages[r.page_id].html), len(r.text))


def test_odd_rows_and_tables(spark, monkeypatch):
    schema = "page_id long, url string, html string, text string, n_chars int, labels int, score double"
    page = f"<nav><a>x</a></nav><article><p>{LONG}</p></article>"
    rows = [(1, None, None), (2, "u", ""), (None, "u", page), (None, "u", page), (4, "u", "<nav><a href=/>only a menu</a></nav>"), (5, "u", page.replace(LONG, (LONG + " ") * 50_000))]
    table = spark.createDataFrame([(*r, "t", 1, 2, 0.5) for r in rows], schema)
    got = {}
    for r in extract.extract(table, extract.built_in()).collect():
        got.setdefault(r.page_id, []).append((r.text, r.n_chars, r.labels, r.score))
    assert got[1] == got[2] == [("", 0, 2, 0.5)] and got[None] == [(LONG, len(LONG), 2, 0.5)] * 2
    assert got[4][0][0] == "" and got[5][0][0] == (LONG + " ") * 49_999 + LONG
    assert extract.extract(table.where("false"), extract.built_in()).count() == 0
    none = extract.train(table.where("false").select("html", "text"))
    assert extract.main_text(page, none) == f"x\n{LONG}"
    monkeypatch.setattr(extract, "CHUNK", 1)
    assert extract.main_text(page, extract.built_in()) == LONG
    made = spark.createDataFrame(extract.labelled_pages(40, seed=3), "html string, text string")
    assert extract.main_text(page, extract.train(made, sample=30)) == LONG
