import html
import re

import pytest

import __spark_entry__ as entry
from assay.llm.html import extract_main_text, main_text
from tests.conftest import SF_CHECK

PAGE = """<!DOCTYPE html><html><head><title>Title</title><style>p{x}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Site</a> <h1>Site name</h1></header><nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav>
<div class="cookie-notice">We use cookies, very long text about cookies that is not the article at all, believe me.</div>
<div class="layout"><aside>Side</aside><article><h1>A &amp; B</h1><p>First <b>bold</b>&nbsp;text,<br>next   line.<p>Short.
<div class="ad">Buy now, buy now, buy now, buy now, buy now</div><p>Last one here with a few more words in it.</p>
<form><label>Mail</label><input name=x><button>Send</button></form>
<section id="comments"><h2>Comments</h2><article><p>First! A comment of some length that readers wrote below.</p></article></section>
</article></div><footer>&copy; Site</footer></body></html>"""


def test_article_without_the_rest():
    assert main_text(PAGE) == ("A & B\n\nFirst bold text, next line.\n\nShort.\n\n"
                               "Last one here with a few more words in it.")


def test_page_without_article_element():
    page = ("<div id=menu><a href=a>Home</a> <a href=b>About</a></div><div class=post><h2>T</h2>"
            "<p>Long text here and there and everywhere, indeed, for a while.</p>Loose text<p>Erat.</div>"
            "<div><a href=q>About us</a></div>")
    assert main_text(page) == "T\n\nLong text here and there and everywhere, indeed, for a while.\n\nLoose text\n\nErat."


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("plain", "plain"), ("<p>open <i>tag", "open tag"), ("<p>cut <a hre", "cut"), ("<!DOCTYPE", ""),
    ("a < b && c", "a < b && c"), ("<script>var x = '<p>no</p>'", ""), ("<p>seen <script>x</script>too", "seen too"),
    ("<p>&lt;b&gt; &#233; &amp;amp;</p>", "<b> é &amp;"), ("<nav>menu<article><p>Text of it</article>", "Text of it"),
    ("<div hidden>gone</div><p>here", "here"), ("<p></p><div> \n</div>", "")])
def test_small_pages(page, want):
    assert main_text(page) == want


ARTICLE = "<h1>Head line</h1>" + "<p>Some words of an article that goes on for a while, as they do.</p>" * 5
SIDE = "<div class='comments'><p>I read it and I do not agree with this at all.</p></div><div class='ad'>Buy now!</div>"


@pytest.mark.parametrize("page", [
    f"<article class='post comment-open'>{ARTICLE}</article>", f"<div class='container has-sidebar'>{ARTICLE}</div>",
    f"<div class='elementor-widget-container'>{ARTICLE}</div>", f"<div id='search-result'><div>{ARTICLE}</div></div>",
    f"<div class='no-sidebar'><div class='social-page'><article>{ARTICLE}</article></div></div>"])
def test_a_name_does_not_drop_the_article(page):
    want = main_text(f"<article>{ARTICLE}</article>")
    assert want.count("Some words") == 5
    assert main_text(f"<body>{page}{SIDE}</body>") == want
    inner = page.replace(ARTICLE, ARTICLE + SIDE)
    assert main_text(f"<body>{inner}</body>") == want


def test_text_beside_the_longest_region():
    long = "<p>Some words of an article that goes on for a while, as they do.</p>" * 12
    last = "<p>In the end the two of them went home and were content.</p>"
    assert main_text(f"<body><div>{long}</div>{last}</body>").endswith("went home and were content.")
    assert main_text(f"<body><section>{long}</section><section>{last}</section></body>").endswith("were content.")
    two = main_text(f"<body><article>{long}</article><article>{last}</article><div class=related><article>{last}</article></div></body>")
    assert two.count("Some words") == 12 and two.count("went home") == 1


COMMENT = "<p>I read the whole of it and cannot say that I agree with any of this.</p>"


@pytest.mark.parametrize("page", [
    f"<form id=aspnetForm><div>{ARTICLE}</div></form>", f"<form><input name=q><nav>menu</nav>{ARTICLE}</form>",
    f"<aside>Side bar<article>{ARTICLE}</article>", f"<aside><div>{ARTICLE}</div>",
    f"<article>{ARTICLE}<form><p>Your mail</p><button>Send</button></form></article>"])
def test_page_wide_form_and_unclosed_aside(page):
    want = main_text(f"<article>{ARTICLE}</article>")
    got = main_text(f"<body>{page}</body>")
    assert got.endswith(want) and len(got) <= len(want) + 12


@pytest.mark.parametrize("name", ["comment-list", "comments", "replies", "post-comments x", "disqus_thread"])
@pytest.mark.parametrize("count", [1, 8, 200])
def test_more_comments_than_text(name, count):
    want = main_text(f"<article>{ARTICLE}</article>")
    many = f"<div class='{name}'>" + f"<div class=item>{COMMENT}</div>" * count + "</div>"
    if "post" in name:  # names the article as well: decided by its share alone
        many = f"<div id=comments>{many}</div>"
    assert main_text(f"<body><div class=post>{ARTICLE}</div>{many}</body>") == want
    assert main_text(f"<body><article>{ARTICLE}</article>{many}</body>") == want
    assert main_text(f"<body><article>{ARTICLE}{many}</article></body>") == want


def test_nested_articles_and_teasers():
    want = main_text(f"<article>{ARTICLE}</article>")
    nested = f"<section>{f'<article>{COMMENT * 3}</article>' * 6}</section>"
    assert main_text(f"<body><article>{ARTICLE}{nested}</article></body>") == want
    teasers = "<article><h3><a href=x>Another story of today</a></h3><p>It begins like this and goes on</p></article>" * 4
    assert main_text(f"<body><article>{ARTICLE}</article>{teasers}</body>") == want
    assert main_text(f"<body><main><article>{ARTICLE}</article><div>{teasers}</div></main></body>") == want
    wrapped = f"<article><h1>T</h1><article>{ARTICLE}</article></article>"
    assert main_text(f"<body>{wrapped}</body>").endswith(want)


def test_deep_and_long_pages():
    assert main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert main_text("<article>" + "<p>word word</p>" * 20_000 + "</article>").count("word word") == 20_000


def _expected(page):
    """The article of the generated pages: what stands between the article's tags, cut at paragraph and heading tags."""
    inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", inner)
    texts = (" ".join(html.unescape(re.sub(r"<[^>]*>?", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in blocks)
    return "\n\n".join(t for t in texts if t)


def test_query_equals_the_generated_articles(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF_CHECK}/pages.parquet").collect()}
    out = entry.queries()["op3_main_text"](spark, SF_CHECK).collect()
    assert len(out) == len(pages)
    for r in out:
        assert r.text == _expected(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def _variants(article):
    yield f"<form id=f>{article}</form>"
    yield f"<div class=post>{article}</div><div class=comment-list>{COMMENT * 60}</div>"
    yield f"<div class='content comments-open'>{article}</div>"
    yield f"<div id=main>{article}</div><aside><p>Read this too</p></aside><div class=ad>Buy now!</div>"


def test_generated_pages_without_article_element(spark):
    """The generated articles in other pages: wrapped in a form, without an article element, with more comments than text."""
    right = total = 0
    for r in spark.read.parquet(f"{SF_CHECK}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        want = _expected(r.html)
        if len(want) < 400 or "<div" in inner or "<section" in inner:
            continue
        for page in _variants(inner):
            got = main_text(f"<html><head><title>t</title></head><body><nav><a href=a>Home</a></nav>{page}<footer>F</footer></body>")
            assert got
            right, total = right + (got == want), total + 1
    assert total > 200 and right >= 0.99 * total


def test_edges(spark):
    rows = [(1, None, None, "a"), (None, "u", PAGE, "b"), (2, "u", PAGE, "c"), (2, "u", PAGE, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key string")
    out = extract_main_text(pages).collect()
    assert len(out) == 4 and {r.n_chars for r in out} == {0, len(main_text(PAGE))}
    assert extract_main_text(pages.limit(0)).count() == 0
