import html
import itertools
import random
import re

import pytest

from lodeweave.llm import html_main as hm

PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header class="site-header"><a href=/>Home</a> Site</header><nav><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></nav>
<div class="cookie-notice">We use cookies.</div>
<main><article><h1>Title &amp; more</h1><p>First <b>bold</b> line<br>goes&nbsp;on &#233;.<p>Second one, unclosed
<div class="ad">Buy now!</div><blockquote>Quoted words here.</blockquote><ul><li>Point one<li>Point two</ul>
<section id="comments"><p>I disagree entirely.</p></section></article></main>
<aside>Related</aside><form><label>Name</label><input><button>Go</button></form><footer>&copy; x</footer></body></html>"""


def test_page():
    got = hm.main_text(PAGE, {}).split("\n")
    assert got == ["Title & more", "First bold line goes on é.", "Second one, unclosed", "Quoted words here.", "Point one", "Point two"]


def test_min_cut_against_all_labels():
    rng = random.Random(0)
    for _ in range(300):
        n = rng.randint(1, 8)
        cost = [rng.choice([-3, -1, -0.5, 0.25, 0.5, 1, 2]) for _ in range(n)]
        links = [(i, j, rng.choice([0.25, 0.5, 1, 2])) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]
        price = lambda x: -sum(c for c, y in zip(cost, x) if y) + sum(w for i, j, w in links if x[i] != x[j])  # noqa: B023, E731
        best = min(price(x) for x in itertools.product([False, True], repeat=n))
        assert abs(price(hm.min_cut(cost, links)) - best) < 1e-9


def test_articles_of_the_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    raw = {r["page_id"]: r["html"] for r in pages.collect()}
    got = hm.extract(pages).collect()
    assert len(got) == len(raw)
    for r in got:
        body = re.search(r"<article>(.*)</article>", raw[r["page_id"]], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p))).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_odd_pages(spark):
    rows = [(1, "u", None, 1), (2, None, "", 1), (None, "u", "<p", 1), (4, "u", "just text, no markup at all. " * 20, 1), (4, "u", "<article>" + "<div>" * 3000 + "deep words here</article>", 1), (5, "u", '<a href="unclosed', 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = hm.extract(df).collect()
    assert len(got) == 6
    assert any("deep words" in r["text"] for r in got)
    assert hm.extract(df.limit(0)).count() == 0


ARTICLE = "".join(f"<p>The council met on day {k} and agreed, after a long debate, to mend the old bridge over the river.</p>" for k in range(6))
MENU = "".join(f'<li><a href="/{k}">Item {k}</a></li>' for k in range(6))
PLAIN = f"<html><body><nav><ul>{MENU}</ul></nav><article>{ARTICLE}</article><footer><p>Copyright.</p></footer></body></html>"


@pytest.mark.parametrize(
    "start, end",
    [
        ('<body><article style="overflow:hidden">', "</article>"), ('<body><article data-id="comment-3">', "</article>"), ("<body><article title='id=ad class=\"sidebar\"'>", "</article>"),
        ('<body class="single with-sidebar"><article>', "</article>"), ('<body><div id="content-with-sidebar"><article>', "</article></div>"),
        ('<body><article class="post comments-open">', "</article>"), ('<body><form action="/"><main>', "</main></form>"), ('<body><div class="sidebar"><article>', "</article></div>"),
        ('<body class="nav header"><div class="post">', "</div>"),
    ],
)
def test_articles_behind_loose_marks(start, end):
    table = {}
    hm.counts(PLAIN, table)
    page = f"<html>{start}{ARTICLE}{end}<nav><ul>{MENU}</ul></nav></body></html>"
    got = hm.main_text(page, hm.log_odds(table))
    assert got.count("The council met") == 6 and "Item" not in got


@pytest.mark.parametrize("start, end", [("<article hidden>", "</article>"), ("<div hidden><article>", "</article></div>"), ('<div class="comments">', "</div>"), ('<article><div id="related-posts">', "</div></article>")])
def test_marks_that_still_count(start, end):
    assert hm.main_text(f"<body>{start}{ARTICLE}{end}</body>", {}) == ""
