import html
import re

import pytest
from pyspark.sql import functions as F

from claimsift.llm.page_text import extract_main_text, host_of, main_text, possible_templates
from claimsift.llm.queries import QUERIES


@pytest.mark.parametrize("page,want", [
    ("", ""),
    ("plain &amp; <b>bold</b>", "plain & bold"),
    ("<p>one<p>two <b>x</b>y<br>z</p>three", "one\ntwo xy z\nthree"),
    ("<article><h1>T&eacute;st&nbsp;a</h1><p> b \n c </p></article>outside", "Tést a\nb c"),
    ("<body><nav>menu</nav><header>top</header><div id='sidebar'>s</div><p>text</p><footer>f</footer>", "text"),
    ("<article><header><h1>Title</h1></header><p>x</p><aside>a</aside><form>f<input></form></article>", "Title\nx"),
    ("<article>a<div class='ad-box'>buy</div><section class=comments><p>reader</section>b</article>", "a\nb"),
    ("<body class='has-sidebar'><main>m <script>if (a<b) '</p>'</script>n</main>", "m n"),
    ("<article><ul><li>i<li>j</ul><table><tr><td>1<td>2<tr><td>3</table>end</article>", "i\nj\n1 2\n3\nend"),
    ("<article><p>a < b &lt;c&gt; <!-- <p>no --> d</article>", "a < b <c> d"),
    ("<div role=navigation>n</div><div hidden>h</div><div style='display: none'>s</div><p>t", "t"),
    ("<article>first</article><article class='comment'>no</article><article>second</article>", "first\nsecond"),
    ("<article><p>cut off &am", "cut off &am"),
    ("<title>x</title><textarea>y</textarea><p>z</p><div class='cookie notice'>c</div>", "z"),
    ("<b>" * 30000 + "deep", "deep"),
    ("<div>" * 3000 + "deep", "deep"),
])
def test_main_text(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize("page,want", [
    ("<div class='elementor-widget-text-editor'><article>a</article></div>", "a"),
    ("<article><div class='post social-share-on'>b</div><p class='share-price'>c</p><div class='alert-story'>d</div></article>", "b\nc\nd"),
    ("<div class='widget'><div class='promo'><article>e</article></div></div><p>rest", "e"),
    ("<div class='banner'><h1>f</h1><p>g</div><div class='menu'>m</div><p>h", "f\ng\nh"),
    ("<div class='related'><article>card</article></div><main>i</main>", "i"),
    ("<div class='related'><article>card</article></div><h1>j</h1><p>k", "j\nk"),
    ("<p>l<div class='comments'><article class='comment'>no</article></div><div class='site-footer'>no</div><div class='related-posts'>no</div>", "l"),
])
def test_a_class_drops_only_what_it_names(page, want):
    assert main_text(page) == want


def test_equal_subtrees_have_equal_digests():
    body, found = possible_templates("<body><div><p>same</p></div><div><p>other</p></div>")
    _, again = possible_templates("<body><section>x</section><div><p>same</p></div>")
    assert len(found) == 4 and len(found & again) == 2


def test_only_containers_of_an_article_can_be_templates():
    _, found = possible_templates("<article><p>text</p><div>box</div></article>")
    assert len(found) == 1


def simple(page):
    article = re.search(r"<article>(.*)</article>", page, re.S).group(1)
    blocks = re.split(r"</?(?:p|h1)>", article)
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b.replace("<b>", ""))).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_query_equals_a_plain_reading(spark):
    sf_dir = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = QUERIES["op3_site_templates"](spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r["url"], r["text"], r["n_chars"]) == (pages[r["page_id"]]["url"], simple(pages[r["page_id"]]["html"]), len(r["text"]))


def test_templates_of_a_host_are_removed(spark):
    page = "<body><div class=x><span>Join our club</span></div><p>Own text {0} of {1}</p><div>Shared words</div></body>"
    rows = [(k, f"https://site.example/{k}", page.format(k, "site")) for k in range(20)]
    rows += [(100 + k, f"https://few.example:80/{k}", page.format(k, "few")) for k in range(3)]
    rows += [(200 + k, "https://copies.example/a", page.format(7, "copies")) for k in range(30)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("templates", F.lit(2))
    got = {r["page_id"]: r["text"] for r in extract_main_text(frame, "page_id", "url", "html").collect()}
    assert got[3] == "Own text 3 of site"
    assert got[101] == "Join our club\nOwn text 1 of few\nShared words"
    assert got[210] == "Join our club\nOwn text 7 of copies\nShared words"  # copies of a page count as one


ARTICLE = "<div class='entry'><p>A council has voted to mend the old bridge before the winter comes.</p><p>Work begins in May.</p></div>"


@pytest.mark.parametrize("page", ["<body><nav>menu {0}</nav><article>" + ARTICLE + "</article></body>", "<body><ul><li>Home {0}<li>News {0}</ul>" + ARTICLE + "</body>"])
def test_copies_with_other_menus_keep_the_article(spark, page):
    frame = spark.createDataFrame([(k, f"https://a.example/{k}", page.format(k)) for k in range(8)], "page_id long, url string, html string")
    texts = [r["text"] for r in extract_main_text(frame, "page_id", "url", "html").collect()]
    assert len(texts) == 8 and all("voted to mend the old bridge" in t and t.endswith("Work begins in May.") for t in texts)


@pytest.mark.parametrize("n_pages", [5, 49, 60, 600])
def test_a_box_on_five_pages_goes_however_large_the_host(spark, n_pages):
    page = "<body>{box}<p>Page {k} tells of its own matter, number {k}, at some length.</p></body>"
    box = "<div class='join'><span>Join our club</span></div>"
    rows = [(k, f"https://a.example/{k}", page.format(k=k, box=box if k < 5 else "")) for k in range(n_pages)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = {r["page_id"]: r["text"] for r in extract_main_text(frame, "page_id", "url", "html").collect()}
    assert texts == {k: f"Page {k} tells of its own matter, number {k}, at some length." for k in range(n_pages)}


@pytest.mark.parametrize("name", "section-header header box-header column-header main-banner comments-policy related-items menu widget notice social".split())
def test_headings_and_paragraphs_are_text_whatever_their_class(name):
    assert main_text(f"<article><h2 class='{name}'>Head</h2><p class='{name}'>text</p><p>more</p></article>") == "Head\ntext\nmore"


@pytest.mark.parametrize("box", ["<section class='responses'>{}</section>", "<div id='disqus_thread'>{}</div>", "<div class='comments'>{}</div>"])
def test_reader_comments_go(box):
    assert main_text("<article><p>text</p>" + box.format("<p>first!</p>") + "</article>") == "text"


def test_very_long_pages(spark):
    frame = spark.createDataFrame([(1, "https://a.b/", "<article>" + "<p>word " * 300_000 + "</article>"), (2, "https://a.b/", "x" * 2_000_000)], "page_id long, url string, html string")
    got = {r["page_id"]: r["n_chars"] for r in extract_main_text(frame, "page_id", "url", "html").collect()}
    assert got == {1: 5 * 300_000 - 1, 2: 2_000_000}


def test_edges(spark):
    rows = [(1, None, None), (2, "no url", ""), (3, "http://a.b/", "<p>x"), (3, "http://a.b/", "<p>x"), (None, "HTTP://U@A.B:8/p", "<p>é</p>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = extract_main_text(frame, "page_id", "url", "html").orderBy("page_id").collect()
    assert [(r["page_id"], r["text"], r["n_chars"]) for r in got] == [(None, "é", 1), (1, "", 0), (2, "", 0), (3, "x", 1), (3, "x", 1)]
    assert [r[0] for r in frame.select(host_of(F.col("url"))).orderBy("page_id").collect()] == ["a.b", "", "", "a.b", "a.b"]
    assert extract_main_text(frame.filter(F.lit(False)), "page_id", "url", "html").count() == 0
