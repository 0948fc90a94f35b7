"""Main text of pages."""

import html
import os
import re

import pytest

from skyframe.llm import html_text

SCHEMA = "page_id long, url string, html string"
FOLDER = "/root/testdata/sf0.01/pages.parquet"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain words", "plain words"),
        ("<article><h1>A &amp; B</h1><p>one<br>two<p>th<b>re</b>e</article>", "A & B one two three"),
        ("<nav><a>menu</a></nav><article><p>x</p></article><footer>f</footer>", "x"),
        ("<article><p>x</p><div class='reader comments'>c</div><form>f</form><aside>s</aside><p>y", "x y"),
        ("<article><div class='cookie-notice'>n</div><p>a\n\t b&nbsp;c</p><script>var t='</p>';</script></article>", "a b c"),
        ("<p>unclosed <b>bold<p>next</div></span>", "unclosed bold next"),
        ("<ul><li>x<li>y</ul><main><p>hello <b>wor</b>ld</p></main>", "hello world"),
        ("<article><p>ends in a ref &am", "ends in a ref &am"),
        ("<div id=c><h1>T</h1><p>" + "word " * 50 + "</p><p>short</p></div><div class=sidebar>x</div>", "T " + "word " * 50 + "short"),
        ("<!-- a comment --><style>p{}</style><title>t</title>", ""),
        ("<article hidden>h</article><article><p>a</p></article>", "a"),
    ],
)
def test_pages(page, text):
    assert html_text.main_text(page) == text


LONG = "many plain words in a row " * 20


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div><p>" + "intro " * 50 + "</p><div><p>" + LONG * 7 + "</p></div></div>", "intro " * 50 + LONG * 7),
        ("<body><h1>Title</h1><p>A lead of some words, on one line.</p><ul><li>" + LONG * 9 + "</ul>", "Title A lead of some words, on one line. " + LONG * 9),
        ("<body><h1>Title</h1><table><tr><td>" + LONG * 9 + "</table>", "Title " + LONG * 9),
        ("<article><p>" + LONG + "</p></article><article><a>b</a><a>c</a></article>", LONG + "bc"),
        ("<div class='layout right-sidebar'><p>" + LONG + "</p></div>", LONG),
        ("<div id='no-sidebar'><p>x y</p></div>", "x y"),
        ("<article class='post comments-open'><p>x y</p></article>", "x y"),
        ("<div class='sidebar'><main><p>x y</p></main><p>z</p></div>", "x y"),
        ("<p>" + LONG + "</p><div class='site-footer'>f</div><p>a <span class='share'>s</span> b</p>", LONG + "a b"),
        ("<article><p>x</p><div class='comments'><article><p>" + LONG + "</p></article></div></article>", "x"),
        ("<article><p>x</p></article><div class='comments'><article><p>" + LONG + "</p></article></div>", "x"),
        ("<div class='sidebar'><article><p>x</p><div class='comments'><article>c</article></div></article></div>", "x"),
    ],
)
def test_nothing_else_is_dropped(page, text):
    assert html_text.main_text(page) == " ".join(text.split())


def test_deep_and_long_pages():
    assert html_text.main_text("<div>" * 3000 + "x") == "x"
    page = "<article>" + "<p>some words here</p>" * 20_000 + "</article>"
    assert html_text.main_text(page) == " ".join(["some words here"] * 20_000)


def test_rows(spark):
    rows = [(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (2, None, None), (None, "v", ""), (3, "w", "<p>b</p>")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'old' AS text")
    found = html_text.extract_text(df)
    assert found.columns == ["page_id", "url", "text"]
    assert sorted(map(str, found.collect())) == sorted(
        f"Row(page_id={i}, url={u!r}, text={t!r})" for (i, u, _), t in zip(rows, ["a", "a", "", "", "b"])
    )
    assert html_text.extract_text(df.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.exists(FOLDER), reason="given tables are absent")
def test_given_pages_by_their_articles(spark):
    for row in html_text.extract_text(spark.read.parquet(FOLDER).selectExpr("*", "html AS page")).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", row["page"], re.S)[1]
        plain = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", inner))
        assert row["text"] == " ".join(html.unescape(plain).split())
