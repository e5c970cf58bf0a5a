"""Templates give what the tree gives."""

from __future__ import annotations

import time

from folioquery.functions.documents import html, templates
from hypothesis import example, given, settings
from hypothesis import strategies as st

_TAGS = ["<p>", "</p>", "<b>", "</b>", "<i>", "</i>", "<br/>", "<br>", "<td>", "<td colspan=2>", "<td rowspan='2'>", "</td>", "<th>", "<tr>", "</tr>", "<table>", "</table>", "<ul>", "</ul>", "<ol>", "<li>", "<div>", "</div>", "<body>", "<img>", "<span style='display:none'>", "</span>", "<style>", "</style>"]
_TAGS += ["<p style=\"page-break-after:always\">", "<div style='page-break-before:always'>", '<div style="position:absolute;left:10px;top:20px">', '<div style="position:absolute;left:90px;top:20px"><b>', '<div style="position:absolute;left:10px;top:60px">', "<div", "<!-- c -->", "<a href='x&amp;y'>"]
_TEXTS = ["", "", " ", "\n a  b ", "1", "$", "%", "[a]", "12.5", "a &amp; b", "&nbsp;", "•", "- x", "Item 1A.", "Part ii", "margin-top: 2px;", "a|b", "x > y", "é​", "long-"]


def _cleared() -> None:
    templates._kept.clear()
    templates._seen.clear()
    templates._tags = 0


def _by_tree(work, source):
    _cleared()
    return work(source)


def _as_made(tags, texts):
    return texts[0] + "".join(t + x for t, x in zip(tags, texts[1:], strict=False))


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(_TAGS), min_size=1, max_size=16), st.lists(st.lists(st.sampled_from(_TEXTS), min_size=17, max_size=17), min_size=2, max_size=3))
@example(["<table>", "<tr>", "<td>", "<td colspan=2>", "<tr>", "<td>", "<td>", "<td>"], [["", "", "", "a", "b", "", "1", "$", "2"] * 2, ["", "", "", "", "b|c", "", "1", "", ""] * 2])
def test_documents_of_one_template_are_those_of_the_tree(tags, rows):
    sources = [_as_made(tags, x) for x in rows]
    for work in (html.to_pages, html.flatten_note):
        wanted = [_by_tree(work, x) for x in sources]
        _cleared()
        assert [work(x) for x in [sources[0], *sources]][1:] == wanted


def test_a_template_is_worked_out_once():
    made = lambda k: "<table>" + "".join(f"<tr><td>{i}</td><td>$</td><td>{k * i}.00</td></tr>" for i in range(40)) + "</table>"
    _cleared()
    slow = []
    for k in range(20):
        tree = html.parse(made(k))
        began = time.perf_counter()
        html.marks(tree)
        html.parse(made(k))
        slow.append(time.perf_counter() - began)
    html.to_pages(made(1)), html.to_pages(made(2))
    fast = []
    for k in range(20):
        began = time.perf_counter()
        html.to_pages(made(k))
        fast.append(time.perf_counter() - began)
    assert sorted(fast)[10] * 3 < sorted(slow)[10]


def test_few_templates_are_kept():
    _cleared()
    for n in range(1, 200):
        for _ in range(2):
            html.to_pages("<p>a" * n * 9)
    assert sum(map(len, templates._kept)) <= templates.TAGS
