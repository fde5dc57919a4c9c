"""Page differencing: alignment against brute force, templates with and without marks, odd rows."""

import random

import pytest

from lectern.llm import html_extract as x

MARKED = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p><article>";</script></head>
<body class="has-sidebar comments-open"><header class="site"><a href="/">Home</a></header><nav><ul><li>One<li>Two</ul></nav>
<div class="cookie-notice">We use cookies</div><div id="page-wrap" class="with-sidebar"><aside>About us</aside>
<article class="post has-comments"><header><h1>Title &amp; more</h1></header><p>First <b>bold</b>&nbsp;text<br>after
  a break.<p>Second&#39;s <a href="x" title="a > b">link</a>.<div class="ad-slot">Buy</div><!-- <p>note</p> -->
<p>Third <span hidden>not this</span> part<form><label>Mail</label><input></form><script>if (a < b) {}</script>
<footer>Written by X</footer><section id="comments"><article class="comment"><p>Nice!</p></article></section></article></div>
<footer>&copy; 2024</footer></body></html>"""


def test_marked_page():
    lines, zones = x.page_lines(MARKED)
    assert " ".join(t for t, z in zip(lines, zones) if z == 1) == "Title & more First bold text after a break. Second's link. Third part"
    assert {"We use cookies", "About us", "Buy", "Nice!", "© 2024", "Home", "Written by X", "not this"} <= {t for t, z in zip(lines, zones) if z == 0}


@pytest.mark.parametrize("html, want", [
    ("", ""),
    ("plain text only", "plain text only"),
    ("<p>a < b and c > d", "a < b and c > d"),
    ("<div class=related><article>Only one</article></div>", "Only one"),
    ("<main>M <nav>n</nav><p>x</main><p>out", "M x"),
    ("<div class='entry-content'><p>Body</div><p>rest", "Body"),
    ("<article>unclosed <p>all &lt;of&gt; it &amp;amp;", "unclosed all <of> it &amp;"),
    ("<a title='never closed>x</a><p>y", "x y"),
    ("<nav>menu</div><p>x", ""),
])
def test_shapes(html, want):
    lines, zones = x.page_lines(html)
    own = 1 if 1 in zones else 2
    assert " ".join(t for t, z in zip(lines, zones) if z == own) == want


def length(a, b):
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, p in enumerate(a):
        for j, q in enumerate(b):
            n[i + 1][j + 1] = n[i][j] + 1 if p == q else max(n[i][j + 1], n[i + 1][j])
    return n[-1][-1]


@pytest.mark.parametrize("most", [4, 1 << 27])
def test_alignment(most, monkeypatch):
    monkeypatch.setattr(x, "LCS_BITS", most)
    r = random.Random(3)
    for _ in range(500):
        a, b = [r.randrange(r.choice([2, 5])) for _ in range(r.randrange(12))], [r.randrange(5) for _ in range(r.randrange(12))]
        got = x.shared_lines(a, b)
        rest = iter(b)
        assert got == sorted(set(got)) and len(got) == length(a, b) and all(a[i] in rest for i in got)


def site(r, host, n, copies=0):
    """Pages of one template without any mark: menu, notice and end in plain divs and tables."""
    words = "sun moon river stone light cloud grass wolf eagle winter summer bridge castle".split()
    for k in range(n):
        own = [" ".join(r.choice(words) for _ in range(12)) + f" {host}{k}x{j}" for j in range(4)]
        if k < copies:
            own = [f"copied {host} line {j} of an article that stands on many pages" for j in range(4)]
        menu = "".join(f"<li><a href=/{w}>{w} {host}</a>" for w in words[:6])
        yield f"https://{host}/a/{r.randrange(10**6):06d}?q={k}", f"<body><ul>{menu}</ul><div>Read our terms {host}</div><div>" + "".join(f"<p>{t}</p>" for t in own) + f"</div><div>All rights {host}</div>", " ".join(own)


@pytest.mark.parametrize("parts", [1, 7])
def test_templates_without_marks(spark, parts):
    """A hot host, ranges that cut it, copies and lone pages; the text is what the template leaves."""
    r = random.Random(parts)
    pages = [p for host, n, copies in (("hot.org", 60, 0), ("b.org", 5, 0), ("one.org", 1, 0)) for p in site(r, host, n, copies)]
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(pages)], "page_id long, url string, html string")
    got = {p.page_id: p for p in x.extract(df, parts).collect()}
    for i, (url, _, want) in enumerate(pages):
        if "one.org" in url:
            assert want in got[i].text and not got[i].paired
        else:
            assert got[i].text == want and got[i].n_deleted == 8 and got[i].n_chars == len(want)


def test_copies_are_no_template(spark):
    r = random.Random(5)
    pages = [(i, u, h) for i, (u, h, _) in enumerate(site(r, "c.org", 6, 6))]
    for p in x.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect():
        assert "copied c.org line 0" in p.text and p.n_deleted == 0
    marked = [(i, f"https://d.org/{i}", f"<nav>m</nav><article><p>same license line</p><p>own words {i} of it</p></article>") for i in range(4)]
    for p in x.extract(spark.createDataFrame(marked, "page_id long, url string, html string")).collect():
        assert p.text == f"same license line own words {p.page_id} of it" and p.n_shared == 2


def test_odd_pages(spark):
    rows = [(1, None, None, "x"), (2, "", "", "x"), (2, "", "", "x"), (None, "not a url", "<p>t</p>", "x"), (3, "http://h/p", "<p>" + "long " * 60000, "x"), (4, "http://h/q", "<div>" * 3000 + "deep", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = x.extract(df)
    assert sorted((p.page_id or 0, p.text[:9], p.n_chars) for p in got.collect()) == [(0, "t", 1), (1, "", 0), (2, "", 0), (2, "", 0), (3, "long long", 299999), (4, "deep", 4)]
    assert x.extract(df.limit(0)).count() == 0
