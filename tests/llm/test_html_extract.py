import html as entities
import re

import pytest

from thicket.llm.html_extract import extract, main_text, op1_html_extract

PARAGRAPHS = [" ".join(f"word{i}{j}" for j in range(30)) + "." for i in range(4)]


def by_pattern(page):
    """The generated pages have one article; its text between tags, a line for each heading and paragraph."""
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    lines = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", " " if x == "<br>" else "", p))).strip() for x in [""] for p in re.split(r"</?(?:h1|p)>", article.replace("<br>", " "))]
    return "\n".join(x for x in lines if x)


def test_whole_table(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = op1_html_extract(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == by_pattern(pages[r.page_id])
        assert r.n_chars == len(r.text)


AROUND = """<!doctype html><html><head><title>T</title><style>p {{}}</style><script>if (a < b) x("<p>no</p>")</script></head><body class="page">
<header class="site-header"><h1>Site</h1><p>Slogan of the site that is quite long, really</p></header><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav>
<div id="cookie-notice"><p>We use cookies, and this notice is long enough to be taken for a paragraph of the article.</div>
<div class="wrap">{article}<div class="sidebar"><h3>Popular</h3><ul><li><a href=1>One two three</a></li><li><a href=2>Four five</a></li></ul></div></div>
<form action=/s><label>Mail <input name=m></label><button>Send this</button></form>
<section id="comments"><h2>Comments</h2><article><p>{comment}</p></article></section>
<aside><p>Advert text that goes on and on and on and on.</p></aside><footer><p>&copy; 2020 Somebody, all rights reserved.</p></footer></body></html>"""


@pytest.mark.parametrize("article", [
    "<article><header><h1>Title &amp; more</h1></header>{}</article>",
    "<main><h1>Title &amp; more</h1>{}</main>",
    "<div class=post><h1>Title &amp; more</h1><div class=body>{}</div></div>",
    "<div><div><h1>Title &amp; more</h1>{}</div></div>",
])
def test_around_is_left_out(article):
    body = "".join(f"<p>{p}</p>" for p in PARAGRAPHS) + '<div class="ad-box">Buy this now</div><p>Short.</p><ul><li>item one<li>item <b>two</b></ul>'
    page = AROUND.format(article=article.format(body), comment="A reader comment, " * 30)
    assert main_text(page) == "\n".join(["Title & more", *PARAGRAPHS, "Short.", "item one", "item two"])


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), (" \n", ""), ("just text  here\n and there", "just text here and there"), ("<p>a<p>b", "a\nb"),
    ("<body><p>a&nbsp;&lt;b&gt; &#8364;&hellip;</p><p>x<br>y</p>", "a <b> €…\nx y"), ("<div>un<b>closed <i>tags</div><div>here", "unclosed tags\nhere"),
    ("<p class=ad>advert<p>text", "text"), ("<ul><li class=menu>no<li>yes</ul>", "yes"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("<script>x", ""), ("<p>a < b and c", "a < b and c"), ("<head><title>t</title><div>body text</div>", "body text"), ("<p>end <", "end <"),
])
def test_small_pages(page, want):
    assert main_text(page) == want


def test_long_and_deep_pages():
    assert main_text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    long = "".join(f"<p><b>paragraph {i}<br>" for i in range(30_000))
    assert main_text(f"<article>{long}</article>").count("\n") == 29_999


def test_nested_formatting():
    page = "<div><span>" + "<i>" * 3000 + "</i>" * 3000 + "<p>text after it"
    assert main_text(page) == "text after it"


TEXT = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
ALL = "\n".join(PARAGRAPHS)


@pytest.mark.parametrize("page, want", [
    (f"<body><form id=aspnetForm method=post><input type=hidden name=state>{TEXT}<input type=submit></form>", ALL),
    (f"<article>{TEXT}<form><p>Write to us</p><input name=m><button>Send</button></form></article>", ALL),
    (f"<article>{TEXT}<section id=discussion><p>What follows from it.</p></section></article>", f"{ALL}\nWhat follows from it."),
    (f"<article><div class=related-work><p>Others found it before.</p></div>{TEXT}</article>", f"Others found it before.\n{ALL}"),
    (f"<article>{TEXT}<p class=notice>A correction was made.</p></article>", f"{ALL}\nA correction was made."),
    (f"<article>{TEXT}<div class=related><a href=1>Another article</a> <a href=2>One more</a></div></article>", ALL),
    (f"<article>{TEXT}<div class=search><input name=q>Search the site</div></article>", ALL),
    (f"<article>{TEXT}<div class=ad>Buy this</div><div id=comments><p>First!</p></div></article>", ALL),
    (f"<p>We read <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here.</p>{TEXT}", f"We read x=2 here.\n{ALL}"),
])
def test_text_decides_where_names_do_not(page, want):
    assert main_text(page) == want


def test_rows(spark):
    rows = [(1, "u", None, 9), (1, "u", None, 9), (None, None, "<p>a</p>", 9), (2, "v", "", 9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    assert sorted((tuple(r) for r in extract(df).collect()), key=str) == [(1, "u", "", 0), (1, "u", "", 0), (2, "v", "", 0), (None, None, "a", 1)]
    assert extract(df.limit(0)).count() == 0
