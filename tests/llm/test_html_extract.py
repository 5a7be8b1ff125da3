"""The article of web pages of several makes, and the pages of the sample tables against their SQL."""

import os

import duckdb
import pytest

from sparkquarry.llm import html_extract
from sparkquarry.llm.html_extract import main_text

LONG = "The mill ground flour, oats and rye for the whole valley; its wheel turned day and night. Nobody knew who had built it, or when."
MORE = "In spring the river rose, as it always did, and the miller opened the upper gate. Then the old stones began to sing."
THIRD = "Years later, when the wheel had rotted, people still told of the sound: low, steady, patient."
MENU = '<li><a href="/a">Home</a></li><li><a href="/b">Products and services</a></li><li><a href="/c">About us</a></li>'

PAGES = {
    "article element": (
        f"<html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><ul>{MENU}</ul></nav>"
        f"<article><header><h1>The mill</h1></header><p>{LONG}<p>Short.<p>{MORE}<aside>Read this too: a long, long, long text, which is no article.</aside>"
        f"<section id='comments'><p>Great post, I liked it, thanks a lot. Really, very nice, indeed!</p></section></article>"
        f"<div class='cookie-notice'>We use cookies, as you may know, to make things better. Do you agree?</div><footer>&copy; us</footer></body></html>",
        f"The mill {LONG} Short. {MORE}",
    ),
    "plain divs": (
        f"<body><div><ul>{MENU}</ul></div><div><div><h1>The mill</h1><div><p>{LONG}</p><p>{MORE}</p><ul><li>oats</li><li>rye, and more</li></ul><p>{THIRD}</p></div></div></div>"
        f"<div><ul>{MENU}</ul></div><div>All rights reserved</div></body>",
        f"The mill {LONG} {MORE} oats rye, and more {THIRD}",
    ),
    "names only": (
        f"<div id='topNav'>{MENU}</div><div class='post-content has-sidebar'><h2>The mill</h2><p>{LONG}</p><div class='share-buttons'>Share this, please.</div><p>{MORE}</p></div>"
        f"<div class='sidebar'><p>{THIRD}</p></div><div class='post-comments'><p>{THIRD}</p></div><form><p>Tell us, please: what do you think, and why?</p></form>",
        f"The mill {LONG} {MORE}",
    ),
    "paragraphs left open": (
        f"<!DOCTYPE html><body><nav>{MENU}</nav><!-- ad > --><div class=\"ad\">Buy now, it is cheap.</div><article><h1>Tom &amp; Jer</h1><p><b>{LONG}<br><p>a&lt;b &quot;c&quot; &am x&nbsp;y  \n z</article><footer>f",
        f'Tom & Jer {LONG} a<b "c" &am x y z',
    ),
    "raw text": ("<article><p>be<b>fo</b>re<script>if (a < b) { say('</p><p>no') }</script> after</p><style>p > a {}</style><textarea><p>no</textarea></article>", "before after"),
    "article of one short block": (f"<nav>{MENU}</nav><div class='ad'>{LONG}</div><article><h1>Hi</h1><p>Hi</p></article><footer>{LONG}</footer>", "Hi Hi"),
    "quoted brackets": ('<article><p title="a > b">one</p><p data-x=\'<p>\'>two</p></article>', "one two"),
    "table": (f"<main><table><tr><td>{LONG}<td>two<tr><td>three</table></main>", f"{LONG} two three"),
    "no text": ("<html><body><nav>menu</nav><script>x</script></body></html>", ""),
    "only brackets": ("< < <3 & &&amp; <", "< < <3 & && <"),
    "open comment": ("<p>one, two.</p><!-- three", "one, two."),
    "null": (None, ""),
    "empty": ("", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_article_of(name):
    page, expected = PAGES[name]
    assert main_text(page) == expected


def test_ratios_tell_prose_from_short_and_linked_blocks():
    page = html_extract.blocks(PAGES["plain divs"][0])
    score = html_extract.scores(page)
    of = {b.text: score[tuple(e.label for e in b.of.path())] for b in page}
    assert of[LONG] == of[MORE] > html_extract.SHARE > of["Home"]


def test_long_and_deep_pages():
    assert len(main_text("<article>" + f"<p>{LONG}</p>" * 20000 + "</article>")) == 20000 * (len(LONG) + 1) - 1
    assert main_text("<div>" * 3000 + LONG) == LONG
    assert main_text("<p>" + "<" * 50000 + " " + LONG).endswith(LONG)


def test_columns_of_odd_rows(spark):
    schema = "page_id long, url string, html string, text string, row int, page string, `a.b` int"
    rows = [(i, None, page, "old", 1, "p", 2) for i, (page, _) in enumerate(PAGES.values())] + [(None, "u", "<p>x</p>", None, None, None, None)] * 2
    out = html_extract.extract_main_text(spark.createDataFrame(rows, schema))
    assert sorted(out.columns) == sorted(["page_id", "url", "html", "text", "row", "page", "a.b"])
    assert sorted(r["text"] for r in out.collect()) == sorted([t for _, t in PAGES.values()] + ["x", "x"])
    assert html_extract.extract_main_text(spark.createDataFrame([], schema)).count() == 0


def test_sample_pages_as_by_sql(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.exists(folder):
        pytest.skip("needs the sample tables")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet')")
    expected = con.sql(f"SELECT page_id, url, text, n_chars FROM ({html_extract.SQL})").fetchall()
    assert sorted(map(tuple, html_extract.op11_html_extract(spark, folder).collect())) == sorted(expected)
