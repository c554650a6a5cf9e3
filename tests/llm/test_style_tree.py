"""Pages against the text they were made from, importances against their definition."""

import html
import math
import re

import pytest

from cellsift.llm import style_tree as s
from cellsift.llm.queries import op6_style_tree


def texts(spark, pages):
    frame = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, text string").repartition(3)
    out = s.main_text(frame)
    assert out.columns == ["page_id", "url", "text"]
    return sorted((str(r.page_id), r.text) for r in out.collect())


def alone(page):
    return s.kept_text([dict(zip(s._KEYS, x)) for x in s.nodes_of(page)])


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        ("<p>a &amp; b&nbsp;&lt;c&gt; &#233;<p>d", "a & b <c> é d"),
        ("<article><h1>T</h1><p>a<b>b</b> c<br>d</article><p>outside", "T ab c d"),
        ("<div>a</div>b<div>c</div>", "a b c"),
        ("<nav>x</nav><header>y</header><main><header><h1>T</h1></header>z</main><footer>f</footer>", "T z"),
        ('<article>a<div class="post ad-box">b</div><section id="comments"><p>c</section><form>d</form>e</article>', "a e"),
        ("<script>var t='</p>';</script><style>p{}</style><p>x<!-- <p>no --> y", "x y"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a b c d"),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", "a b c d"),
        ('<p title="a > b">x</p><p hidden>y</p><div role="navigation">z</div>', "x"),
        ("a < b <p>c", "a < b c"),
        ("<p>un<b>closed<p>next", "unclosed next"),
        ("<article></article><p>body", "body"),
        ('<article class="comment">c</article><article>t</article>', "t"),
        ("<script>never closed <p>x", ""),
        ('<p>address of add</p><div class="address">kept</div>', "address of add kept"),
    ],
)
def test_one_page(page, want):
    assert alone(page) == want


@pytest.mark.parametrize(
    "page, want",
    [
        ('<article class="post tag-advertising category-newsletter"><h1>T</h1><p>text</article>', "T text"),
        ('<div class="content no-sidebar"><p>text</div><div class="with-sidebar">b</div><div class="has-comments">c</div>', "text b c"),
        ('<p>text<div class="share-price">12.5</div><div id="elementor-widget">d</div>', "text 12.5 d"),
        ('<form id="aspnet"><div class="menu">m</div><p>all of the page</form>', "all of the page"),
        ('<form><nav>n</nav><main><p>x</main></form><div>much more text outside</div>', "x"),
        ('<div class="modal"><p>most of the page</div><div class="main-nav">home</div><p>rest', "most of the page rest"),
        ('<div id="right-sidebar"><p>a wrapper</p><div class="sidebar">links</div></div>', "a wrapper"),
        ('<article class="newsletter"><p>the letter itself</article><article>teaser</article>', "the letter itself teaser"),
        ('<main class="promo"><p>m</main><div>outside of it</div>', "m"),
        ('<article>text<div id="comments"><p>comments of more words than the text</div></article>', "text"),
        ('<div>text</div><div class="comment-list"><p>comments of more words than the text</div>', "text"),
        ('<article>text</article><div class="ad">an advert of more words than the text</div>', "text"),
        ('<article class="sponsored">s</article><div>other things</div><article class="comment">a comment</article>', "s"),
        ('<article class="sponsored">s</article><div>other things</div>', "s"),
        ('<div class="replies"><p>only these</div>', "only these"),
        ('<p>text<div class="site-footer">f</div><div class="ad-728x90">a</div><div class="cookie-banner">b</div>', "text"),
    ],
)
def test_names_take_no_main_text(page, want):
    assert alone(page) == want


UNSURE = ("notice", "share", "login", "skip", "banner", "social", "alert", "related", "promo", "modal")


@pytest.mark.parametrize("name", UNSURE)
def test_passages_of_articles_with_an_unsure_name(spark, name):
    def page(i, inner):
        return f"<nav><a>home</a></nav><article><h1>T{i}</h1><p>text {i}</p><div class='{name}-box'><p>{inner}</p></div><p>end</p></article>"

    own = [(i, "http://own.example/", page(i, f"its own words {i}")) for i in range(6)]  # part of the text
    same = [(10 + i, "http://same.example/", page(i, "Follow us <b>everywhere</b>")) for i in range(6)]  # part of the site
    short = [(20, "http://a.example/", f"<article><p>x</p><div class='{name}'>no paragraph</div><form class='{name}'><p>f</p></form></article>")]
    got = dict(texts(spark, own + same + short))
    for i in range(6):
        assert got[str(i)] == f"T{i} text {i} its own words {i} end"
        assert got[str(10 + i)] == f"T{i} text {i} end"
    assert got["20"] == "x"


def test_sure_names_leave_articles():
    for name in ("ad", "sponsored", "comments", "newsletter", "cookie-notice", "main-nav", "sidebar"):
        assert alone(f"<article><p>x</p><div class='{name}'><p>words of its own</p></div></article>") == "x"


def test_long_and_deep_pages():
    assert alone("<div>" * 50_000 + "x" + "</div>" * 50_000) == "x"
    assert alone("<p>" + "word " * 200_000 + "</p>") == ("word " * 200_000).strip()


def test_template_of_a_site_leaves(spark):
    def page(i, words):
        return f"<body><div class='x1'><div>Our shop</div><div>Follow us</div></div><div class='x2'><div>{words}</div><p>id {i}</p></div></body>"

    pages = [(i, "http://a.example/%d" % i, page(i, f"text number {i * 7}")) for i in range(12)]
    pages += [(100 + i, "http://a.example/c", page(0, "text number 0")) for i in range(30)]  # copies count once
    pages += [(200, "http://b.example/", page(5, "other host")), (201, None, page(6, "no url")), (None, "http://A.example/x", page(7, "no id"))]
    got = dict(texts(spark, pages))
    for i in range(12):
        assert got[str(i)] == f"text number {i * 7} id {i}"
    assert got["100"] == "text number 0 id 0" and got["None"] == "no id id 7"
    assert got["200"] == "Our shop Follow us other host id 5" and got["201"] == "Our shop Follow us no url id 6"


def test_repeated_paragraphs_of_articles_stay(spark):
    pages = [(i, "http://a.example/", f"<article><p>text {i}</p><p>All rights reserved.</p><div>Read more at home</div></article>") for i in range(9)]
    assert texts(spark, pages) == sorted((str(i), f"text {i} All rights reserved.") for i in range(9))


def test_a_site_of_copies_keeps_its_text(spark):
    assert set(t for _, t in texts(spark, [(i, "http://a/", f"<div>same</div><!-- {i} -->") for i in range(9)])) == {"same"}


def test_importances(spark):
    rows = [("h", 1, c, False) for c in (5, 5, 5, 6)] + [("h", 2, c, True) for c in (7, 7, 7, 8)] + [("h", 3, 9, True)]
    got = {(r.place, r.content): (r.own, r.styles) for r in s.importances(spark.createDataFrame(rows, "host string, place long, content long, leaf boolean")).collect()}
    entropy = -(3 / 4 * math.log(3 / 4, 4) + 1 / 4 * math.log(1 / 4, 4))
    assert got[1, 5] == pytest.approx((entropy, 2)) and got[1, 6] == pytest.approx((entropy, 2))
    assert got[2, 7] == pytest.approx((1 - math.log(3, 4), 2)) and got[2, 8] == pytest.approx((1.0, 2))
    assert (3, 9) not in got  # one page only


def test_whole_importance_joins_own_and_children():
    def node(at, parent, leaf, own, styles=1, solid=0):
        return {"at": at, "parent": parent, "leaf": leaf, "solid": solid, "own": own, "styles": styles}

    page = [node(0, -1, False, 0.0, 2), node(1, 0, True, 0.0), node(2, 0, True, 0.4), node(3, 0, False, 0.0), node(4, 3, True, 0.1)]
    # 3: 0.1 * 0 + 0.9 * 0.1; 0: 0.19 * 0 + 0.81 * (0 + 0.4 + 0.09) / 3
    assert s.low_branches(page) == [4, 3, 1, 0]
    page[2]["own"] = 1.0
    assert s.low_branches(page) == [4, 3, 1]
    page[3]["solid"] = 1  # a paragraph beside the leaf: 0.9 * (0.1 + 1) / 2
    assert s.low_branches(page) == [4, 1]


def test_empty_table(spark):
    assert s.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html or "" for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op6_style_tree(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?!b>)[a-z0-9]+>", " ", article))).split())
        assert r.text == want and r.n_chars == len(want)
