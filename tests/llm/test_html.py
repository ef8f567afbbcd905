import html
import re

import pytest
from pyspark.sql import functions as F

from wardlake.llm import mainhtml, queries

BODY = "<p>A long paragraph of the article with many words in it, so that it is text.</p>"


def plain(page: str) -> str:
    inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inner)]
    return "\n".join(b for b in blocks if b)


def test_query_equals_the_marked_article(spark, small):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = queries.QUERIES["op8_main_html"](spark, small).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == plain(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("   ", ""), ("<script>x()</script>", ""), ("<p>", ""), ("<", "<"),
    ("<nav><a>Home</a></nav>" + BODY + "<footer>Foot</footer>", "A long paragraph of the article with many words in it, so that it is text."),
    ("<article><h1>T</h1>" + BODY + "<p>Hm.</p><section class='comments'><p>First reader comment, long and loud and long.</p></section></article>",
     "T\nA long paragraph of the article with many words in it, so that it is text.\nHm."),
    ("<div id=cookie-notice>We use cookies for everything that you can think of and more.</div><main>" + BODY + "</main>",
     "A long paragraph of the article with many words in it, so that it is text."),
    ("<article>" + BODY + "<form><label>Mail</label></form><aside>See also</aside><p>a &amp; b &copy;\n  c<b>d</b></article>",
     "A long paragraph of the article with many words in it, so that it is text.\na & b © cd"),
    ("<article><ul><li>one<li>two</ul><table><tr><td>x<td>y</table>" + BODY, 
     "one\ntwo\nx\ny\nA long paragraph of the article with many words in it, so that it is text."),
    ("<div><div><a>x</a><a>y</a></div><div>" + BODY * 3 + "</div><div><a>z</a></div></div>",
     "\n".join(["A long paragraph of the article with many words in it, so that it is text."] * 3)),
    ("<article><p>cut off in the mid", "cut off in the mid"),
])
def test_pages(page, want):
    assert mainhtml.extract(page) == want


def test_edges(spark):
    rows = [(1, "u", None, "own"), (None, None, "<article>" + BODY * 2000, "own"), (2, "u", "x", "own"), (2, "u", "x", "own")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string").withColumn("n_chars", F.lit("own"))
    got = mainhtml.main_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == 4
    assert got.filter("page_id is null").first()["text"].count("\n") == 1999
    assert mainhtml.main_text(pages.limit(0)).count() == 0


def words(name: str, size: int) -> str:
    return " ".join([name] * (size // (len(name) + 1)))


@pytest.mark.parametrize("inner", ["p", "li", "blockquote", "td", "h2", "span", "div"])
def test_one_long_block_is_not_the_page(inner):
    """One block longer than all others together does not drop them."""
    long, short = words("long", 600), words("short", 300)
    page = f"<html><body><h1>Title</h1><{inner}>{long}</{inner}><p>{short}</p></body></html>"
    assert mainhtml.extract(page) == f"Title\n{long}\n{short}"


def test_a_nested_article_does_not_replace_its_main():
    long, short = words("long", 600), words("short", 500)
    page = f"<main><p>{short}</p><article><p>{long}</p></article></main>"
    assert mainhtml.extract(page) == f"{short}\n{long}"
    assert mainhtml.extract(f"<main><a>x</a><a>y</a><article><p>{long}</p><p>{short}</p></article></main>") == f"{long}\n{short}"


LINE = "A long paragraph of the article with many words in it, so that it is text."


@pytest.mark.parametrize("page,want", [
    (f'<div class="content has-sidebar">{BODY * 2}</div>', [LINE] * 2),
    (f'<div class="layout no-sidebar">{BODY}</div>', [LINE]),
    (f'<body><form action="x">{BODY * 2}<input name="q"></form></body>', [LINE] * 2),
    (f'<article>{BODY}<section id="discussion"><h2>Discussion</h2>{BODY}</section></article>', [LINE, "Discussion", LINE]),
    (f'<article><p id="share-of-votes">{LINE}</p>{BODY}</article>', [LINE] * 2),
    (f"<article><p>Energy <math><mi>E</mi></math> is {LINE}</p>{BODY}</article>", [f"Energy E is {LINE}", LINE]),
    (f'<div class="widget-area"><article>{BODY}</article></div>', [LINE]),
    (f'<div class="sidebar"><p>Other things that you may like</p></div><div>{BODY * 3}</div>', [LINE] * 3),
    (f'<article>{BODY * 2}<div class="cookie-notice"><h2>Cookies</h2><p>We use them.</p></div></article>', [LINE] * 2),
])
def test_parts_in_doubt(page, want):
    """Names of layout, forms around a page, topics with a heading and inline parts do not cost any text."""
    assert mainhtml.extract(page) == "\n".join(want)
