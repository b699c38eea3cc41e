"""Top-k search and HTML extraction."""

import math
import random
import re
import time

import duckdb
import numpy as np
import pytest

from setforge.llm import html, mtree, queries


def plain_top(rows, k=10):
    ok = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in ok:  # a query row asks for itself, also where its id repeats
        if q % 100 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def check_top(spark, rows, monkeypatch=None):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert sorted(map(tuple, mtree.top_k(df).collect())) == plain_top(rows)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(mtree, "PAGE", 120)
    monkeypatch.setattr(mtree, "QUERIES", 3)
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 1, (6, 8))
    rows = [(k, (centres[k % 6] * (1 + k % 3) + rng.normal(0, 0.1, 8)).tolist()) for k in range(700)]
    rows += [(1000 + k, [1.0] * 8) for k in range(300)]  # one vector very often: ties by id
    rows += [(3000, None), (3100, [float("nan")] * 8), (3200, [None] + [1.0] * 7), (None, [1.0] * 8), (3300, [float("inf")] * 8), (3400, []), (3500, [0.5, 0.5]), (3600, [0.0] * 8)]
    check_top(spark, rows)


def test_top_k_repeated_ids(spark, monkeypatch):
    """Each query row has a list of its own, as in the SQL; repeated candidates are rows of their own."""
    monkeypatch.setattr(mtree, "PAGE", 6)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 1, 4).tolist()) for i in [0, 0, *range(1, 14), 13, 13, 100, 100]] + [(100, [1.0] * 4)] * 3
    check_top(spark, rows)
    embeddings = spark.createDataFrame(rows, "vec_id long, embedding array<float>").toPandas()  # noqa: F841
    rel = duckdb.sql(queries.OP6_SQL.replace("from embeddings", "from (select vec_id, embedding::float[] as embedding from embeddings)"))
    assert sorted((q, int(r), i, s) for q, r, i, s in rel.fetchall()) == plain_top([(i, np.float32(v).tolist()) for i, v in rows])


def test_top_k_sends_pages_once_for_many_queries(spark, monkeypatch):
    """Copies of one vector: rows built into pages are those of the table, whatever the number of query blocks."""
    monkeypatch.setattr(mtree, "PAGE", 50)
    monkeypatch.setattr(mtree, "QUERIES", 4)
    built = []
    monkeypatch.setattr(mtree, "stored", lambda df, f=mtree.stored: built.append(f(df)) or built[-1])
    rng = np.random.default_rng(2)
    rows = [(k if k % 3 else 100 * k, rng.normal(0, 1, 4).tolist()) for k in range(600)]  # 200 queries
    check_top(spark, rows)
    pages = next(df for df in built if "apart" in df.columns and "ids" in df.columns)
    assert pages.selectExpr("sum(size(ids))").first()[0] == 600 and pages.selectExpr("max(size(ids))").first()[0] < 600


def test_top_k_few_and_none(spark):
    check_top(spark, [(0, [1.0, 2.0]), (100, [1.0, 2.0]), (7, [-1.0, 0.5])])
    check_top(spark, [(5, [1.0])])
    check_top(spark, [])


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li><li>B</ul></nav><div class="cookie-notice"><p>We use cookies</p></div>
<article><h1>Head &amp; tail</h1><p>First <b>bold</b>
 words.<br>Next line<p>Short.<div class="ad">Buy!</div><ul><li>one<li>two &eacute;</ul><form><p>Mail</p><input></form><aside>Side</aside>
<table><tr><td>1<td>2</table></article>
<section id="comments"><p>A long comment of a reader that says very much about nothing at all, again and again and again.</p></section><footer>&copy; me</footer></body></html>"""


def test_html_article():
    assert html.extract(PAGE) == "Head & tail\n\nFirst bold words. Next line\n\nShort.\n\none\n\ntwo é\n\n1 2"


def test_html_without_article():
    long = "Some real words of the story go on here. " * 12
    page = f"<body><div class='sidebar'><p>{long}</p></div><div><a href=a>x</a> <a href=b>y</a></div><div id=story><p>{long}</p><p>End.</p></div></body>"
    assert html.extract(page) == f"{long.strip()}\n\nEnd."
    assert html.extract("<div class='content-with-sidebar'><article class='post comments-open'><p>kept</article><div class='site-header'>no</div></div>") == "kept"
    assert html.extract("plain &amp; text") == "plain & text" and html.extract("<p>a</p><p>b</p>") == "a\n\nb"


def test_html_region_holds_the_whole_article():
    part = lambda c, n=12: " ".join([f"A {c} sentence that is long enough to be content."] * n)
    both = f"{part('first')}\n\n{part('second', 8)}"
    p = lambda *texts: "".join(f"<div><p>{t}</p></div>" for t in texts)
    links = "<div><ul>" + "<li><a href='#'>x</a></li>" * 12 + "</ul></div>"
    assert html.extract(f"<body>{links}<div id='content'>{p(part('first'), part('second', 8))}</div></body>") == both
    assert html.extract(f"<body><section><p>{part('first')}</p></section><section><p>{part('second', 8)}</p></section></body>") == both
    many = [part(str(k), 2) for k in range(9)]
    assert html.extract(f"<div><div>{p(*many)}</div></div>") == "\n\n".join(many)
    aside = f"<body><div>{links}<div><p>{part('intro', 1)}</p></div><div><p>{part('first', 40)}</p><p>End.</p></div></div></body>"
    assert html.extract(aside) == f"{part('intro', 1)}\n\n{part('first', 40)}\n\nEnd."
    for tag in ("main", "div"):  # a teaser is not the article
        page = f"<body><{tag}><h1>Title</h1><p>{part('first')}</p><p>{part('second', 8)}</p><article class='teaser'>Read this too</article></{tag}></body>"
        assert html.extract(page).startswith(f"Title\n\n{both}")


def test_html_teasers_reviews_and_comments_are_not_the_article():
    x = html.extract
    story = "".join(f"<p>A <b>short</b> <i>part</i> {k}.</p>" for k in range(6))
    told = "\n\n".join(f"A short part {k}." for k in range(6))
    teaser = f"<article class=card>{'Another story is told at length elsewhere. ' * 8}</article>"
    assert x(f"<main><article>{story}</article></main>{teaser}") == told
    assert x(f"<main><article>{story}</article>{teaser}</main>") == told
    assert x(f"<article><h1>Head</h1>{story}</article>{teaser}") == f"Head\n\n{told}"
    assert x(f"<main><h1>Head</h1><article>{story}</article>{teaser}</main>") == f"Head\n\n{told}"
    assert x(f"<article>{story}</article><article class='comment-body'><p>{'I read that with joy. ' * 30}</p></article>") == told
    assert x("<div><h1>Title</h1><p>intro</p></div><div>" + "body of the story " * 20 + "</div>") == "Title\n\nintro\n\n" + ("body of the story " * 20).strip()
    review = f"<section class='{{}}'><p>{'A reader found it good and says so at length. ' * 20}</p></section>"
    assert x(f"<body><article><h1>Head</h1>{story}</article>{review.format('reader-reviews')}") == f"Head\n\n{told}"
    assert x(f"<body><article><h1>Head</h1>{story}</article>{review.format('x')}") == f"Head\n\n{told}"
    assert x(f"<body><div><h1>Site</h1></div><article><h1>Head</h1>{story}</article>{review.format('x')}") == f"Head\n\n{told}"
    assert x(f"<body><div><h1>Head</h1>{story * 9}</div><article><h1>Other</h1>{story}</article>").startswith("Head\n\n" + told)
    assert x("<article><p>It cost</p><p class='share-price'>12</p><p class='modal-verb'>must</p><div class='siteNav'>no</div><div class='ad-300x250'>no</div><div class='entry-header'>yes</div></article>") == "It cost\n\n12\n\nmust\n\nyes"


def test_html_the_ratio_decides(monkeypatch):
    """Without names and semantic elements the clusters alone tell a menu and a list of teasers from the text; a constant ratio doesn't."""
    text = [f"Sentence {k} of the text goes on for a while, as sentences of texts do. " * 3 for k in range(8)]
    menu = "<div>" + "".join(f"<div><a href=/{k}>Entry {k}</a></div>" for k in range(20)) + "</div>"
    dates = "<div>" + "".join(f"<div><b>{k}</b><i>May</i><u>x</u></div>" for k in range(20)) + "</div>"
    page = f"<body>{menu}{dates}<div>{''.join(f'<p>{t}</p>' for t in text)}<p>Short.</p></div>{dates}</body>"
    exp = "\n\n".join([t.strip() for t in text] + ["Short."])
    assert html.extract(page) == exp
    two = f"<article>{menu}{dates}</article><article>{''.join(f'<p>{t}</p>' for t in text)}</article>"
    assert html.extract(two) == exp.removesuffix("\n\nShort.")
    monkeypatch.setattr(html, "smoothed", lambda r: np.ones(len(r)))
    assert html.extract(page) != exp and html.extract(two) != exp


def test_html_smoothing_and_clusters():
    r = np.array([0.0, 0, 10, 0, 0, 3])
    k = [[math.exp(-0.5 * ((i - j) / 1.5) ** 2) if abs(i - j) <= 5 else 0 for j in range(6)] for i in range(6)]
    assert np.allclose(html.smoothed(r), [sum(w * x for w, x in zip(row, r)) / sum(row) for row in k])
    chars = np.array([5] * 20 + [400] * 5 + [5] * 20)
    got = np.flatnonzero(html.clusters(chars, np.ones(45)))
    assert {20, 21, 22, 23, 24} <= set(got) <= set(range(18, 27))


def test_html_deep_pages_take_linear_time():
    began = time.process_time()
    assert html.extract("<div>x" * 20_000).count("x") == 20_000
    assert html.extract("<b>y" * 20_000 + "</b>" * 20_000) == "y" * 20_000
    assert html.extract("<article>" + "<i><p>z" * 20_000).count("z") == 20_000
    assert time.process_time() - began < 10


def test_html_dropped_parts_end_where_their_end_tag_is_implied():
    x = html.extract
    assert x('<article><p class="ad">Buy<p>one</p><p>two</p></article>') == "one\n\ntwo"
    assert x('<article><p class="ad"><b>Buy<div>one</div><p>two</p></article>') == "one\n\ntwo"
    assert x('<article><p class="ad">Buy<nav><a>x</a></nav><p>two</p></article>') == "two"
    assert x('<article><ul><li class="share">Tell<li>one<li>two</ul><p>three</article>') == "one\n\ntwo\n\nthree"
    assert x('<article><ul><li class="share"><a>Tell<ul><li>no<li>no</ul><p>no<li>one</ul></article>') == "one"
    assert x('<article><dl><dt class="ad">no<dd>one<dd class="ad">no<dt>two</dl></article>') == "one\n\ntwo"
    assert x('<article><table><tr><td class="ad">no<td>one<tr class="ad"><td>no<tr><td><p class="ad">no<td>two</table></article>') == "one\n\ntwo"
    assert x('<article><div class="ad"><p>no<p>no<ul><li>no<li>no</ul></div><p>one</article>') == "one"
    assert x("<html><head><title>no</title><meta charset=x><script>no</script><body><p>one") == "one"
    assert x("<html><head><title>no</title>one") == "one"


def test_html_odd_rows(spark):
    rows = [(1, "u", None, "t"), (2, None, "", "t"), (None, "u", "<p>x", "t"), (3, "u", "<" * 2000, "t"), (4, "u", "<div>" * 3000 + "deep", "t"), (4, "u", "<div>" * 3000 + "deep", "t"), (5, "u", "<p>" + "long " * 50_000, "t"), (6, "u", "<script>only</script>", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.report(df).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 8 and by[1].text == by[2].text == by[6].text == "" and by[4].text == "deep" and by[5].n_chars == 249_999 and by[None].text == "x"
    assert html.report(df.limit(0)).count() == 0


def test_html_random_nesting_never_fails():
    rng = random.Random(0)
    bits = ["<p>", "</p>", "<div>", "</div>", "<article>", "</article>", "<nav>", "</nav>", "<b>", "</b>", "<br>", "text ", "&amp;", "<!-- c -->", "</x>", "<li>", "<td>", "<img src=a>", "<script>", "</script>"]
    for _ in range(300):
        html.extract("".join(rng.choice(bits) for _ in range(40)))


def plain_main_text(page):
    """The article of a page by patterns alone: what is said of the generated pages, not how the operator finds it."""
    import html as entities

    page = re.sub(r"(?s)<!--.*?-->|<(script|style|nav|footer|aside)\b.*?</\1>|<div class=\"ad\">.*?</div>", "", page)
    blocks = re.split(r"</?(?:p|h\d|div|ul|ol|li|table|tr|blockquote|pre)\b[^>]*>", re.search(r"(?s)<article>(.*)</article>", page)[1])
    lines = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<(?:br|td|th)\b[^>]*>", " ", b))).split()) for b in blocks]
    return "\n\n".join(x for x in lines if x)


def test_main_text_of_all_pages_against_patterns(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html.report(pages).collect()}
    exp = {r.page_id: plain_main_text(r.html) for r in pages.collect()}
    assert got == exp and len(exp) > 100


def test_clusters_decide_among_boxes_without_telling_names():
    para = "<p>" + "A long paragraph of text that says many things about a topic. " * 5 + "</p>"
    text = " ".join(["A long paragraph of text that says many things about a topic."] * 5)
    page = f'<body><div class="q1"><h1>T</h1>{para}<p>Short.</p><div class="zz"><h3>Join us</h3><p>Now <a href=x>here</a></p></div>{para}<div><p>The end.</p></div></div><div class="q2"><b>More</b> for <a href=x>you</a></div></body>'
    assert html.extract(page) == f"T\n\n{text}\n\nShort.\n\n{text}\n\nThe end."
    old, html.clusters = html.clusters, lambda c, t: c < 0
    try:
        assert html.extract(page) == ""  # without clusters there is no content
    finally:
        html.clusters = old


def test_forms_and_headers_that_hold_the_article():
    para = "<p>" + "A long paragraph of text that says many things about a topic. " * 5 + "</p>"
    text = " ".join(["A long paragraph of text that says many things about a topic."] * 5)
    assert html.extract(f'<body><form id=aspnetForm><nav>x</nav><div><h1>T</h1>{para}{para}</div></form></body>') == f"T\n\n{text}\n\n{text}"
    assert html.extract(f"<body><header><h1>Site</h1></header><article><header><h1>Title</h1><p>By me</p></header>{para}</article></body>") == f"Title\n\n{text}"
    assert html.extract(f'<article><h1>T</h1>{para}<form><label>Mail</label><p>Send me news of all kinds</p></form></article>') == f"T\n\n{text}"
    assert html.extract(f"{para}<p>3 < 4 and x</p><![foo") == f"{text}\n\n3 < 4 and x"
    assert html.extract(f"{para}<!DOCTYPE [") == html.extract(f"{para}<!-- never closed <p>no</p>") == text
    assert html.extract('<p>a<script>if (a<b && c="</p>") x</script>b</p><style>p{') == "a b"


@pytest.mark.parametrize("end", ["", '">'])
@pytest.mark.parametrize("start", ["<a ", '<p title="', "<", "</", "</p", "<!", "<![", "<!--", "<![CDATA[", "&#", "<a b=", "<a b= '", "<a 'x", "<script>", "<style", "<a/", "<p a='b\">"])
def test_time_in_proportion_to_what_is_left_open(start, end):
    began = time.process_time()
    html.extract(start * 40_000 + end)
    assert time.process_time() - began < 4  # a quadratic one takes minutes


def test_top_k_of_huge_components(spark):
    """One long vector ends no job; those whose scores need not fit a long take no part, as in the SQL."""
    rows = [(0, [1.0, 2.0]), (1, [4e6, 0.0]), (2, [1e300, 1.0]), (3, [1.25e6, -3.0]), (100, [-1.0, 5.0]), (4, [0.5, 0.5]), (200, [-1e300, 1e300])]
    got = sorted(map(tuple, mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    assert got == plain_top([r for r in rows if r[0] not in (1, 2, 200)])
    con = duckdb.connect()
    con.execute("create table embeddings(vec_id bigint, embedding double[])")
    con.executemany("insert into embeddings values (?, ?)", rows)
    assert sorted((q, int(r), i, s) for q, r, i, s in con.sql(queries.OP6_SQL).fetchall()) == got
