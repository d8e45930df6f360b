import itertools
import random
import time

import pytest

from logforge.llm import mincut

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a = "</p>";</script></head><body class="sidebar">
<header class="site-header"><h1>Site name</h1><a href=x>Home</a></header><nav><ul><li>One</li></ul></nav>
<div class="cookie-notice"><p>We use cookies. Please accept all of them, as everybody does.</p></div>
<main><article><header><h1>My &amp; title</h1></header><p>First   para
with text &lt;b&gt; and more text here.<aside>Related: a link</aside><ul><li>item one</li><li>item two</li></ul><p>Short.</p>
<form><label>Email</label><input></form><div class="ad">Buy now!</div><p>Last para, with <a href=y>a link</a>.</p></article>
<section id="comments"><h2>Comments</h2><p>A reader says at great length that all of this is wrong, and goes on and on and on about it.</p></section></main>
<div id="sidebar"><p>Popular posts and more things to read on this site.</p></div><footer>&copy; 2024 Site</footer></body></html>"""


def cost(odds, edges, labels):
    return sum(abs(o) for o, k in zip(odds, labels) if (o >= 0) != k) + sum(c for a, b, c in edges if labels[a] != labels[b])


def test_cut_is_minimal():
    r = random.Random(4)
    for _ in range(300):
        n = r.randint(1, 9)
        odds = [r.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, r.uniform(0, 1.5)) for a in range(n) for b in range(a) if r.random() < 0.5]
        best = min(cost(odds, edges, x) for x in itertools.product((True, False), repeat=n))
        assert cost(odds, edges, mincut.min_cut(odds, edges)) == pytest.approx(best)


def test_page():
    assert mincut.main_text(PAGE) == "My & title\n\nFirst para with text <b> and more text here.\n\nitem one\n\nitem two\n\nShort.\n\nLast para, with a link."


LONG = "A long sentence that reads like any other in this place, and goes on for a good while, as sentences do."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div class=header>Site</div><div class=post><h1>T</h1><p>{LONG}</p></div><div class='side-bar'><p>{LONG}</p></div>", f"T\n\n{LONG}"),
        (f"<article><h1>T</h1><p>{LONG}</p><section id=comments><p>{LONG}</p></section></article>", f"T\n\n{LONG}"),
        (f"<article><p>{LONG}</p><article class='comment depth-1'><p>{LONG}</p></article><p>End.</p></article>", f"{LONG}\n\nEnd."),
        (f"<main><p>{LONG}</p><p style='display: none'>{LONG}</p><p hidden>{LONG}</p></main>", LONG),
        (f"<article class='post comments-open'><p>{LONG}</p></article><div class=newsletter-signup><p>{LONG}</p></div>", LONG),
        (f"<article><p>{LONG}</p><ul class='related-links'><li><a href=x>{LONG}</a></li></ul></article>", LONG),
    ],
)
def test_boilerplate_of_many_kinds(page, text):
    assert mincut.main_text(page) == text


@pytest.mark.parametrize("tag", ["script", "STYLE", "select", "button"])
def test_letters_that_grow_in_lower_case(tag):
    page = f"<html><HEAD><title>İİİİ</title></Head><body><article><p>{LONG}</p><{tag}>İİ</{tag.swapcase()}><p>İşte {LONG}</p><{tag}>x</{tag}><p>Son.</p></article>"
    assert mincut.main_text(page) == f"{LONG}\n\nİşte {LONG}\n\nSon."


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!--", "<script>x", "</div></div>", "<p>" * 500, "<a href='>'>x</a>"])
def test_broken_pages(page):
    assert isinstance(mincut.main_text(page), str)


PROSE = "Whoever reads this far finds one more sentence of the usual length, and after it the next one."
LINKS = "".join(f"<li><a href=/{k}>Topic {k}</a></li>" for k in range(6))
#: Pages without and with semantic elements, and their main text.
MIXED = [
    (f"<div><ul>{LINKS}</ul></div><div><h2>Title</h2><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p></div><div><ul>{LINKS}</ul></div>", ["Title", PROSE, "Short.", PROSE]),
    (f"<table><tr><td><a href=x>Home</a> <a href=y>News</a></td></tr></table><div><p>{PROSE}</p><p>Yes</p><p>{PROSE}</p><ul><li>one</li><li>two</li></ul></div>", [PROSE, "Yes", PROSE, "one", "two"]),
    (f"<article><h1>T</h1><p>No</p><div><div>a</div><p>ok</p></div><ul>{LINKS}</ul></article><div><p>{PROSE}</p></div>", ["T", "No", "a", "ok", *[f"Topic {k}" for k in range(6)]]),
    (f"<article><p>{PROSE}</p><div class=legal><p>{PROSE}</p></div><div class='post tags'><p>{PROSE}</p></div><blockquote class=alert>{PROSE}</blockquote></article>", [PROSE] * 4),
    (f"<article><p>{PROSE}</p><div class=ad><div><p>{PROSE}</p><p>{PROSE}</p></div></div><p>End</p></article>", [PROSE, "End"]),
    (f"<main><p>{PROSE}</p><div id=comments>" + f"<div><p>{PROSE}</p></div>" * 12 + "</div></main>", [PROSE]),
    (f"<body><div class=sidebar><section><p>{PROSE}</p></section></div><div><p>{PROSE}</p><p>x</p></div></body>", [PROSE, "x"]),
    ("<article><p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> here.</p><p><svg><text>label</text></svg></p></article>", ["Energy is E=m here.", "label"]),
]


def test_mixed_pages_need_the_edges():
    by_sign = by_tag = 0
    for page, want in MIXED:
        blocks, tree = mincut.blocks_of(page)
        assert mincut.main_text(page) == "\n\n".join(want)
        odds, _ = mincut.network(blocks, tree)
        by_sign += [b.text for b, o in zip(blocks, odds, strict=False) if o >= 0] == want
        by_tag += [b.text for b in blocks if tree[b.element].inside] == want
    assert by_sign <= 1 and by_tag <= 3


def test_rows_of_equal_odds_need_the_flow(monkeypatch):
    cut = []
    flow = mincut.max_flow
    monkeypatch.setattr(mincut, "max_flow", lambda odds, edges: cut.append(len(odds)) or flow(odds, edges))
    assert mincut.main_text(f"<div><p>{PROSE}</p><p>Yes</p></div><div><a href=x>Home</a><p>Ok then</p></div><div><p>{PROSE}</p></div>")
    assert mincut.main_text(MIXED[1][0]) and cut


@pytest.mark.parametrize("part", ["<a ", "<a '", '<a "', "<!x", "<!--", "<select>", "<div>", "</ul><div>", "<title>", "<p", "&", "<div>x", "<p>Yes<ul><li>a", "<a href=x>y</a><p>"])
def test_hostile_pages_take_linear_time(part):
    page = "<article>" + part * (300_000 // len(part))
    start = time.perf_counter()
    mincut.main_text(page)
    assert time.perf_counter() - start < 40


def test_long_page():
    body = "".join(f"<p>Paragraph number {i} of a very long article.</p>" for i in range(3000))
    assert mincut.main_text(f"<nav>menu</nav><article>{body}</article><footer>f</footer>").count("\n\n") == 2999


def test_all_pages(spark, sf):
    import html
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    truth = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1].replace("<br>", " ")
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:h1|p)>", inner)]
        truth[r["page_id"]] = "\n\n".join(b for b in blocks if b)
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in mincut.extract(pages).collect()}
    assert got == {k: (v, len(v)) for k, v in truth.items()}


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, 1), (1, None, None, 1), (None, "u", "", 2)], "page_id long, url string, html string, n_chars int")
    assert [r["text"] for r in mincut.extract(df).collect()] == ["", "", ""]
    assert mincut.extract(df.where("page_id > 5")).count() == 0
