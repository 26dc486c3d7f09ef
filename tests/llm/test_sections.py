"""Pages without article or main keep all text that isn't furniture or a list of links."""

import time

import pytest

from phonospark.llm import htmlext

LONG = "A paragraph, with commas, and words, that goes on, and on. " * 10
LINKS = "<ul>" + "".join(f"<li><a href={k}>Link number {k}</a>" for k in range(30)) + "</ul>"


def lines(page):
    return [x for x in htmlext.extract(page).split("\n") if x]


def test_short_closing_section():
    page = f"<body><div class=content><div><p>{LONG}</p><p>{LONG}</p></div><div><p>Short closing sentence.</p></div></div></body>"
    assert lines(page) == [LONG.strip(), LONG.strip(), "Short closing sentence."]


def test_siblings_of_any_tag():
    tags = [("ul", "<ul><li>item</ul>"), ("ol", "<ol><li>step</ol>"), ("q", "<blockquote>quoted</blockquote>"), ("t", "<table><tr><td>cell</table>"), ("pre", "<pre>code</pre>"), ("h3", "<h3>three</h3>"), ("h6", "<h6>six</h6>")]
    page = "<body><div class=content>" + "".join(x for _, x in tags[:3]) + f"<div><p>{LONG}</p></div>" + "".join(x for _, x in tags[3:]) + "bare words</div></body>"
    assert lines(page) == ["item", "step", "quoted", LONG.strip(), "cell", "code", "three", "six", "bare words"]


def test_links_and_furniture_go():
    page = f"<body><div class=x>{LINKS}</div><nav>menu</nav><div class=content><div><p>{LONG}</p></div><div>{LINKS}</div><section><p>End.</p></section></div><div id=footer>foot</div></body>"
    assert lines(page) == [LONG.strip(), "End."]
    heavy = f"<body><div>{LINKS * 30}</div><div class=content><div><p>{LONG}</p></div><p>End.</p></div></body>"
    assert lines(heavy) == [LONG.strip(), "End."]


N = 100_000
HARD = {"nested": "<div>text" * N, "inline": "<b>x" * N, "ends": "<i><div>" + "<b>" * N + "</i>" * N, "open quotes": '<a title="x' * N, "signs in quotes": '<a "x>y" ' * N, "both quotes": "<a \"'>" * N, "signs": "<" * N, "names": "<a" * N, "declarations": "<!" * N, "comments": "<!-- x ->" * N, "items": "<ul><li>" * N, "terms": "<div><dt></dt>" * N, "paragraphs": "<p>text" * N, "cells": "<table><tr><td>x" * (N // 3)}


@pytest.mark.parametrize("name", HARD)
def test_hard_pages_take_linear_time(name):
    began = time.time()
    htmlext.extract(HARD[name])
    assert time.time() - began < 5


def test_tags_and_text():
    assert htmlext.extract('<p title="a > b">x</p><p title=\'"\'>y</p>') == "x\ny"
    assert htmlext.extract("<p>1 < 2 <br/>and 3 > 2<p>a<3b") == "1 < 2 and 3 > 2\na<3b"
    assert htmlext.extract("<p>see <a href=http://x.com/>this</a> and that") == "see this and that"
    assert htmlext.parse("<p><a href=http://x.com/>this</a> end")[1][0].linked == 4
    assert htmlext.extract("<p>a<!-- b --!>c<!-- never closed <p>d") == "ac"
    assert htmlext.extract('<p>a <b title="never closed>c</b> d') == 'a c d'


LONG = "A long sentence of the article, with commas, clauses, and words enough to score well, goes on and on. " * 3


@pytest.mark.parametrize("page, want", [
    (f"<div><article><p>{LONG}</p></article><blockquote>A quote.</blockquote><h3>More</h3><ul><li>one<li>two</ul><pre>code</pre></div>", [LONG.strip(), "A quote.", "More", "one", "two", "code"]),
    (f"<main2><article><p>{LONG}</p></article><article><p>Short one.</p></article></main2>", [LONG.strip(), "Short one."]),
    (f"<body><form action=x><nav>menu</nav><article><h1>T</h1><p>{LONG}</p></article></form></body>", ["T", LONG.strip()]),
    (f"<body><div class='form-group'><article><p>{LONG}</p></article></div><p>Closing line.</p></body>", [LONG.strip()]),
    (f"<div><article><p>{LONG}</p></article><ul><li><a href=1>one link</a><li><a href=2>another</a></ul><form>Search <input> here</form></div>", [LONG.strip()]),
    (f"<article><p>{LONG}</p></article><div class=comments><p>{LONG * 9}</p></div>", [LONG.strip()]),
])
def test_articles_keep_what_stands_beside_them(page, want):
    assert htmlext.extract(page).split("\n") == want
