"""Operator 8 on pages that are cut, nested deeply or wide: time and output in proportion to the page; odd tables."""

import time

import pytest

from siltstone.llm import html

PAGES = {
    "open style": "<style>" + "word one two. " * 75_000,
    "styles": "<style>" * 150_000,
    "at signs": "<style>" + "@" * 1_000_000,
    "lists": "<ul><li>x" * 20_000,
    "quotes": "<blockquote>x" * 20_000,
    "columns": "<table><tr>" + "<td colspan=1000>x" * 10_000,
    "tables": "<table><tr><td>a<td>" * 10_000 + "z" * 1000,
    "padding": "<table><tr><td>" + "x" * 300_000 + "<td>y" + "<tr><td>a<td>b" * 5000,
    "open quotes": '<a "' * 250_000,
    "open values": '<a x="' * 100_001,
    "comments": "<!--" * 250_000,
}


@pytest.mark.parametrize("name", PAGES)
def test_in_proportion(name):
    page = PAGES[name]
    begun = time.process_time()
    text = html.visible_text(page)
    assert time.process_time() - begun < 2 and len(text) < 50 * len(page)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<p>a</p><a href="foo>b</a>', "a"), ('<a "foo>b</a>', "b"), ("<a title='x>y' href=z>b</a>", "b"), ("<p>a</p><b", "a"),
        ("<style>.x{display:none!important}</style><p class=x style='display:block'>a</p>b", "b"),
        ("<style>.x{display:none !important;display:block}</style><p class=x>a</p>b", "b"),
        ("<style>p{display:none}</style><p style='display:block'>a</p>b", "a\n\nb"),
        ("<style>@media print{p{display:none}} b{display:none}</style><p>a</p><b>c</b>", "a"),
        ("<dialog>x</dialog><dialog open>y</dialog>", "y"),
        ("<details>q<summary>s</summary>body</details><details open><summary>t</summary>u</details>", "s\nt\nu"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
        ("<table><tr><td colspan=900>wide<td>b<tr><td>c<td>d</table>", "wide    b\nc  d"),
    ],
)
def test_visibility_and_quotes(page, text):
    assert html.visible_text(page) == text


def test_odd_tables(spark):
    rows = [(None, "<p>a", 1), (1, None, 2), (1, "", 3), (1, "<p>b", 4), (1, "<p>b", 5), (2, " ", 6)]
    found = html.extract_text(spark.createDataFrame(rows, "page_id long, html string, text int")).collect()
    assert sorted(((r.page_id, r.text, r.n_chars) for r in found), key=str) == sorted([(None, "a", 1), (1, "", 0), (1, "", 0), (1, "b", 1), (1, "b", 1), (2, "", 0)], key=str)
    assert html.extract_text(spark.createDataFrame([], "page_id long, html string")).count() == 0
