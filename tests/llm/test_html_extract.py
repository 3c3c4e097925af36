import itertools
import time

import numpy as np
import pytest

from fluvial.llm import html_extract as h

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head>
<body><header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>
<div class="cookie-notice">We use cookies</div><main><article><h1>Title &amp; more</h1><p>First <b>bold
 text</b>&nbsp;here.<br>On<p>Second &lt;b&gt; one.<div class="ad">Buy <i>now</i></div><!-- no <p>x</p> --><ul><li>item</ul>
<section class="comments"><p>I disagree</p></section><form><p>Mail</p><button>Send</button></form><p>Last.</article></main>
<aside><p>Related things</p></aside><footer>&copy; us</footer></body></html>"""


def test_page():
    assert h.main_text(PAGE).split("\n") == ["Title & more", "First bold text here. On", "Second <b> one.", "item", "Last."]


@pytest.mark.parametrize("page", ["", " ", "<", "<p", "<!--", "<script>", "</p></div>", "a<b>c", "<p>" * 3000 + "x"])
def test_odd_pages(page):
    assert isinstance(h.main_text(page), str)


def test_cut_is_least():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n = int(rng.integers(1, 8))
        gain = rng.normal(0, 2, n)
        edges = [(i, j, float(rng.random() * 2)) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.5]

        def cost(keep):
            return sum(max(g, 0) for g, k in zip(gain, keep, strict=True) if not k) + sum(max(-g, 0) for g, k in zip(gain, keep, strict=True) if k) + sum(c for i, j, c in edges if keep[i] != keep[j])  # noqa: B023

        got = h.minimum_cut(gain, edges)
        assert cost(got) == pytest.approx(min(map(cost, itertools.product([False, True], repeat=n))))


def test_extract(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (1, "u", PAGE), (None, "w", "<article><p>é😀</p></article>"), (5, "x", "<article>" + "<p>word</p>" * 5000)]
    pages = spark.createDataFrame([(i, u, t, 1) for i, u, t in rows], "page_id long, url string, html string, text long")
    got = h.extract(pages).collect()
    assert len(got) == len(rows) and {r.page_id: r.n_chars for r in got} == {1: 65, 2: 0, 3: 0, None: 2, 5: 24_999} | {1: len(h.main_text(PAGE))}
    assert all(r.n_chars == len(r.text) for r in got)
    assert h.extract(pages.limit(0)).count() == 0


def test_classifier_learns_from_telling_elements(spark):
    pages = spark.createDataFrame([(i, PAGE) for i in range(20)], "page_id long, html string")
    w = h.fit(pages)
    page = "<div><div><a href=x>one</a></div><div><a href=y>two</a></div><div>A long sentence, with many words in it. And another one, which goes on and on.</div></div>"
    found = h.blocks(page)
    judged = h.described(found) @ w
    assert judged[2] > judged[0] and judged[2] > judged[1]


TEXT = "<h1>Title</h1><p>First one.</p><p>Second one.</p>"


@pytest.mark.parametrize(
    "page",
    [
        '<body class="no-sidebar"><article>{}</article></body>',
        '<body class="has-sidebar page"><main>{}</main></body>',
        '<body class="nav-fixed"><div class="content">{}</div></body>',
        '<article class="post comments-open">{}</article>',
        '<div class="has-sidebar"><div class="content">{}</div><div class="sidebar">Other</div></div>',
        '<div class="comments-open widget"><main>{}</main></div>',
        '<div class="content nav-fixed">{}</div>',
        '<div class="with-sidebar"><article>{}</article></div>',
        '<form id="login"><article>{}</article></form>',
        '<div id="menu"><article>{}<section class="comments"><article>Reply</article></section></article></div>',
        '<article>{}</article><div class="related"><article>Other</article></div><div class="footer"><div class="content">Us</div></div><nav><article>Way</article></nav>',
    ],
)
def test_names_on_the_frame_lose_no_text(page):
    assert h.main_text(page.format(TEXT)).split("\n") == ["Title", "First one.", "Second one."]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>One <svg width=1/> two</p><p>Three</p>", ["One two", "Three"]),
        ("<p>One <svg><g><svg/></g><text>no</text></svg> two</p><p>Three</p>", ["One two", "Three"]),
        ("<p>Sum <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds<math/>.</p><p>Three</p>", ["Sum x=1 holds.", "Three"]),
        ("<p>One <select><option>no<p>Two</p><p>Three <video><p>no</p></video></p>", ["One", "Two", "Three"]),
        ("<div>One <object data=x>no</div><p>Two</p><p>a<object>no<object>no</object>no</object>b</p>", ["One", "Two", "ab"]),
        ("<p>One<canvas>no</p><p>Two<audio>no", ["One", "Two"]),
        ("<p>One<script/>no<p>no</p></script></p><p>Two</p>", ["One", "Two"]),
    ],
)
def test_only_skipped_elements_are_dropped(page, want):
    assert h.main_text(f"<article>{page}</article>").split("\n") == want


UNTOLD = """<html><body><div><div><a href=/a>Home</a></div><div><a href=/b>News</a></div><div><a href=/c>About us</a></div></div>
<div><div><h2>Storm</h2><p>A long sentence, with many words in it, which says what happened on that day. And another one, which goes on.</p>
<p>So it was</p><p>More words follow here, one after the other, so that it reads as prose does. They end at last, as all words do, in time.</p>
<p>Those who saw it, and those who did not, had much to say of it. Most of it was true, some was not, and none of it helped.</p></div></div>
<div><div><a href=/i>Imprint</a></div><div><a href=/t>Terms</a></div></div></body></html>"""


def test_the_cut_decides_where_markup_says_nothing():
    page = h.blocks(UNTOLD)
    assert not any(b.said for b in page)
    gain, _ = h.costs(page, h.PRIOR)
    keep = h.labels(page, h.PRIOR)
    for text in ("Storm", "So it was"):
        at = [b.text for b in page].index(text)
        assert gain[at] < 0 and keep[at]  # by itself it is boilerplate, among its neighbours it isn't
    assert h.main_text(UNTOLD).split("\n")[0] == "Storm" and len(h.main_text(UNTOLD).split("\n")) == 5


def test_no_block_outweighs_its_edges_in_an_element():
    assert h.JUDGED < 2 * (h.NEXT + h.TOGETHER)
    page = h.blocks("<article>" + "<p>It was said, and then done, as they had agreed to do before.</p>" * 5 + "</article>")
    gain, edges = h.costs(page, h.PRIOR)
    gain[2] = -h.JUDGED
    assert h.minimum_cut(gain, edges)[2]


def test_query_equals_brute_force(spark):
    """Small pages of random parts: the text is that of the least of all labellings."""
    import random

    rng = random.Random(3)
    parts = ["<p>Some words of prose, which end.</p>", "<p><a href=x>link</a></p>", "<div>bare words</div>", "<div class=ad>Buy now</div>", "<ul><li>one<li><a href=y>two</a></ul>", "<h2>Head</h2>", "<section><p>Inner text, of a section.</p></section>", "<nav><a href=z>way</a></nav>"]
    rows = [(i, "u", "".join(rng.choice(["<article>", "<div>", "<aside>", "</div>", "", ""]) + rng.choice(parts) for _ in range(rng.randint(1, 6)))) for i in range(40)]
    got = {r.page_id: r.text for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), h.PRIOR).collect()}
    for i, _, page in rows:
        found = h.blocks(page)
        gain = [max(-h.JUDGED, min(h.JUDGED, sum(f * w for f, w in zip(x, h.PRIOR, strict=True)))) for x in h.described(found)]
        best = {}
        for keep in itertools.product([False, True], repeat=len(found)):
            cost = sum(max(g, 0) if not k else max(-g, 0) for g, k in zip(gain, keep, strict=True))
            last = {}
            for j, b in enumerate(found):
                if j and keep[j] != keep[j - 1]:
                    cost += h.NEXT / (1 + b.steps)
                before = last.get(b.parent)
                if before is not None and keep[before] != keep[j]:
                    cost += h.TOGETHER / (1 + b.steps) if before == j - 1 else h.TOGETHER
                last[b.parent] = j
                if b.above >= 0 and keep[b.above] != keep[j]:
                    cost += h.TOGETHER / (1 + b.depth)
            best.setdefault(round(cost, 6), []).append("\n".join(b.text for b, k in zip(found, keep, strict=True) if k))
        assert got[i] in best[min(best)]


def test_fit_needs_no_markup_and_counts_copies_once(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefg"), 4))
    prose = lambda: " ".join(word() for _ in range(30)) + "."
    html = [f"<title>{i} t</title><div><div><a href=a>Home</a></div><div>We use them all</div></div><div><h1>{i} t</h1><p>{prose()}</p><p>{prose()}</p></div>" for i in range(30)]
    pages = spark.createDataFrame([(i, "u", x, 1, "a") for i, x in enumerate(html)] + [(0, "u", html[0], 1, "a")] * 40 + [(None, None, None, None, None)], "page_id long, url string, html string, page int, said string")
    w = h.fit(pages)
    assert (w == h.fit(pages.repartition(3))).all() and (w != h.PRIOR).any()
    assert h.main_text(html[3], w).startswith("3 t\n") and "We use" not in h.main_text(html[3], w)
    assert (h.fit(pages.limit(0)) == h.PRIOR).all()
    assert (h.fit(pages, most_bytes=10) == h.PRIOR).all()


PROSE = "It was a long day, and they had much to do, so they began early. When it was done, nobody spoke of it again. " * 8
LINKS = "<ul><li><a href=a>First source</a></li><li><a href=b>Second source</a></li></ul>"


@pytest.mark.parametrize(
    "page",
    [
        "<article><h1>Title</h1><p>{p}</p></article><section class=comments><p>{p}</p><p>{p}</p></section>",
        "<article><h1>Title</h1><p>{p}</p><section class=comments><p>{p}</p></section></article>",
        "<main><h1>Title</h1><p>{p}</p></main><aside><p>{p}</p><p>{p}</p></aside>",
        "<div class=ad>{p}</div><article><h1>Title</h1><p>{p}</p></article><footer><p>{p}</p></footer>",
        "<div class=cookie-notice><p>{p}</p></div><article><h1>Title</h1><p>{p}</p></article><form><p>{p}</p></form>",
        "<article><h1>Title</h1><div class=ad>{p}</div><p>{p}</p></article><div id=sidebar><p>{p}</p></div>",
    ],
)
def test_long_prose_in_boilerplate_stays_out(page):
    assert h.main_text(page.format(p=PROSE)).split("\n") == ["Title", PROSE.strip()]


@pytest.mark.parametrize("page", ["<article><h1>Title</h1><p>{p}</p>{a}</article>", "<article><h1>Title</h1>{a}<p>{p}</p></article>", "<article><h1>Title</h1><p>{p}</p>{a}<p>No.</p></article>", "<article>{a}</article>"])
def test_lists_of_links_in_an_article_stay(page):
    assert {"First source", "Second source"} <= set(h.main_text(page.format(p=PROSE, a=LINKS)).split("\n"))


@pytest.mark.parametrize("part,end", [("<a ", ""), ("<", ""), ('<a "', ""), ('<a "', ">"), ("<script ", ""), ("<title>", ""), ("<a", ' ">'), ("<p x='", ">"), ("<!--", ""), ("<div>", "</p>" * 50_000)])
def test_broken_markup_takes_time_in_proportion(part, end):
    """None of these parts is a tag that ends, or none is closed; 200,000 characters and more take seconds at most."""
    page = "<p>Some text.</p>" + part * 60_000 + end
    start = time.perf_counter()
    assert h.blocks(page)[0].text == "Some text." and h.title_of(page) == ""
    assert time.perf_counter() - start < 10


def test_tags_end_outside_of_quotes():
    texts = lambda page: [b.text for b in h.blocks(page)]
    assert texts("<p title='a > b'>one</p><p x=\"'>'\">two</p>") == ["one", "two"]
    assert texts("a < b <p>c << d</p>") == ["a < b", "c << d"]
    assert texts('<p>one <a href="x>two</p>') == ['one <a href="x>two']
    assert texts("<p>x<!-- > --><!doctype y><script>1 < 2 > 3</script>z</p>") == ["xz"]
    assert h.title_of("<TITLE\nx>A &amp; b</title ><title>c</title>") == "A &amp; b"
