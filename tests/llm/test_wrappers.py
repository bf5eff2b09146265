import html
import re

import pytest

from posframe.llm import wrappers
from posframe.llm.common import table


def plain(source):
    """The text of the tables' pages, by their own markup."""
    article = re.search(r"<article>(.*?)</article>", source or "", re.S)
    if not article:
        return ""
    parts = re.split(r"</?(?:h1|p)>", article[1])
    lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts)
    return "\n".join(x for x in lines if x)


def test_whole_table(spark):
    at = "/root/testdata/sf0.1"
    want = {r.page_id: plain(r.html) for r in table(spark, at, "pages").collect()}
    out = wrappers.op8_main_text(spark, at).collect()
    assert len(out) == len(want)
    for r in out:
        assert r.text == want[r.page_id] and r.n_chars == len(r.text)


SITE = """<!doctype html><html><head><title>T{k}</title><style>p {{}}</style></head><body class="main ad-free">
<header><a href=/>Site name</a></header><div id="top-nav"><a href=/a>One</a><a href=/b>Two {k}</a></div>
<main><h1>Head &amp; {k}</h1><p>First {k} <i>para</i>graph.<p>Second,
 with &nbsp; space<script>if (a < b) "</p>"</script><div class="cookie notice">Accept</div><ul><li>x{k}<li>y</ul>
<aside>Side {k}</aside><form><label>Name</label><input></form><section class='comments'><p>Nice {k}!</p></section></main>
<!-- <p>no --><div class="sponsored">Buy</div><footer>&copy; {k}"""


def test_roles(spark):
    rows = [(k, "https://h.example/x", SITE.format(k=k)) for k in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in wrappers.extract(df).collect():
        k = r.page_id
        assert r.text == f"Head & {k}\nFirst {k} paragraph.\nSecond, with space\nx{k}\ny"


def test_hosts_without_regions(spark):
    """What stays the same from page to page, or is links, is no main text."""
    page = "<html><body><div>My site</div><div><a href=a>L{k}</a> <a href=b>M{k}</a></div><div><p>Story {k}.</p>{more}</div><div>All rights</div></body></html>"
    rows = [(k, f"http://a.b/{k}", page.format(k=k, more=f"<p>More {k}.</p>" * (k % 3))) for k in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in wrappers.extract(df).collect():
        assert r.text == "\n".join([f"Story {r.page_id}."] + [f"More {r.page_id}."] * (r.page_id % 3))


def test_wrapper_is_a_regular_expression():
    made = wrappers.Wrapper()
    for k in (1, 2, 3):
        made.learn(wrappers.Page(f"<body><b>Books:</b><ul>{''.join(f'<li>b{k}{i}</li>' for i in range(k))}</ul>{'<img>' if k == 2 else ''}</body>"))
    assert made.expression() == "<body <b 'Books:' </b <ul (<li # </li)+ </ul (<img)? </body"


def test_edges(spark):
    deep = "<div>" * 30000 + "x" + "</div>" * 30000
    rows = [(1, None, None), (2, "not a url", ""), (3, "http://x.y", "<<<>>&&lt;<p"), (None, "http://x.y", "<article>a<br>b"), (None, "http://x.y", "<article>a<br>b"), (4, "http://x.y", "<article>" + "<p>w " * 50000), (5, "http://z", deep), (6, "http://q", "<a href='x>y")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    out = [(r.page_id, r.text) for r in wrappers.extract(df).collect()]
    assert len(out) == len(rows)
    by = dict(out)
    assert by[1] == by[2] == "" and by[None] == "a b" and by[4] == "\n".join(["w"] * 50000) and by[5] == "x"
    assert wrappers.extract(df.filter("false")).count() == 0


@pytest.mark.parametrize("html,text", [
    ('<div class="has-sidebar"><article class="comments-open post"><p>x</p></article></div>', "x"), ('<main class="ad-free">x</main>', "x"), ('<div class="sidebar"><article>x</article></div>', "x"),
    ('<article><p class="share-price">p</p><h2 id="social-history">h</h2><div class="share-buttons">no</div><div class="comment-list">no</div></article>', "p\nh"),
    ('<main>x</main><section class="comments"><article class="comment">no</article></section>', "x"), ("<aside><article>no</article></aside><main>x</main>", "x"), ("a <b", "a <b"), ("x > y <!-- c", "x > y"),
])
def test_classes(html, text):
    made = wrappers.Wrapper()
    made.learn(wrappers.Page(html))
    assert wrappers.Extractor(made.dumps()).text(html) == text


def test_wrapper_decides_without_regions(spark):
    """On a host without article or main, what stays the same over pages goes, however long
    and wherever it stands, and long texts that differ at their ends only stay."""
    shared, long_ = "the same words on each page " * 40, "long beginning " * 60
    rows = [(k, f"http://h.example/{k}", f"<body><div><b>{shared}</b></div><h2>{long_}{k}</h2><p>own {k}</p></body>") for k in range(6)]
    out = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    for r in out:
        assert r.text == f"{long_}{r.page_id}\nown {r.page_id}"
    # copies of one page say nothing about what is constant
    rows = [(k, "http://h.example/", "<body><p>only text</p></body>") for k in range(6)]
    assert {r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"only text"}


def test_alignment_is_a_longest_one(monkeypatch):
    import random

    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before, row = row, [0]
            for j, y in enumerate(b):
                row.append(before[j] + 1 if x == y else max(row[-1], before[j + 1]))
        return row[-1]

    for table in (1 << 30, 50):
        monkeypatch.setattr(wrappers, "_TABLE", table)
        for seed in range(200):
            random.seed(seed)
            a, b = (random.choices("abcd", k=random.randrange(40)) for _ in range(2))
            pairs = wrappers.align(a, b)
            assert len(pairs) == length(a, b) and all(a[i] == b[j] for i, j in pairs)
            assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))


def test_long_units_are_folded():
    unit = [f"<x{k}" for k in range(30)]
    assert wrappers.fold(["<a", *unit * 4, "</a"])[0] == ["<a", "(" + " ".join(unit) + ")+", "</a"]


@pytest.mark.parametrize("part", ['<a "', "<p><table>", "<li><b>", "<td>", "<!"])
def test_malformed_pages_take_linear_time(part):
    import time

    start = time.time()
    wrappers.Page(part * 40000)
    assert time.time() - start < 10
