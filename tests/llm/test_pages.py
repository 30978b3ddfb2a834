"""Main text of pages: the articles of the given pages, and rules on small ones."""

import html
import re

from conftest import SMALL

from tellerlake.llm import catalog, html_text

PROSE = "The cat is on the mat and it was in the house of the man that had been there for all of the day."


def test_articles(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    rows = catalog.op10_main_text(spark, SMALL).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n\n".join(p for p in parts if p)
        assert r.n_chars == len(r.text)


def test_short_blocks_inherit():
    page = f"<div class='menu'>Home</div><div>{PROSE}<p>Short.</div><div id=comments><p>{PROSE}</div><p>a &lt; b"
    assert html_text.main_text(page) == f"{PROSE}\n\nShort.\n\na < b"


def test_linked_and_marked_blocks_go():
    page = (f"<article><header><h1>Head</h1></header><p>{PROSE}</p><ul><li><a href=x>More to read</a></ul>"
            f"<section class='comments'><p>{PROSE}</p></section><form>Name</form></article><footer>{PROSE}</footer>")
    assert html_text.main_text(page) == f"Head\n\n{PROSE}"


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<p"), (4, "u", "plain < text"), (None, "u", "<!-- <p>x</p>"),
            (5, "u", "<script>" + "x" * 100_000), (5, "u", "<p>" * 3000 + "deep")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, n_chars int")
    found = html_text.extract(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"] and found.count() == len(rows)
    assert html_text.extract(pages.limit(0)).count() == 0
