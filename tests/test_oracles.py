"""Every registered query with SQL gives DuckDB's rows; the others give some."""

import re
from collections import Counter
from html import unescape

import pytest
from compare import assert_same

from folioquery.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf, name):
    assert_same(spark, sf, QUERIES[name], SQL[name])


def test_html_pages(spark, sf):
    """Every document, pages from 1 without gaps, no error; the visible words are those of the tables' own tokenizer."""
    rows = QUERIES["html_pages"](spark, sf).collect()
    source = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    found = {}
    for r in rows:
        assert r.error is None
        found.setdefault(r.page_id, {})[r.page] = r.content
    assert set(found) == set(source) and all(sorted(p) == list(range(1, len(p) + 1)) for p in found.values())
    for i, p in found.items():
        bare = re.sub(r"(?is)<(script|style|head|title|noscript|template)\b.*?</\1>|<!--.*?-->", " ", source[i])
        bare = unescape(re.sub(r"<[^>]*>", " ", bare))
        words = lambda t: Counter(re.findall(r"[^\W_]+", t))
        pages, text = words(re.sub(r"(?m)^\d+\. ", "", " ".join(p.values()))), words(bare)
        assert not text - pages and not pages - text  # every visible word is there, as often as in the source


def test_html_retention(spark, sf):
    got = {r.page_id: r.retention for r in QUERIES["html_retention"](spark, sf).collect()}
    assert set(got) == {r.page_id for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert all(r is None or r > 0.95 for r in got.values())


def test_chunk_pack(spark, sf):
    """No sentence is lost or repeated, and a chunk above the budget is one sentence or one table alone."""
    from folioquery.functions.documents import chunker

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    chunks = {}
    for r in QUERIES["chunk_pack"](spark, sf).collect():
        chunks.setdefault(r.id, []).append(r)
    letters = lambda t: re.sub(r"\s+", "", t)
    for i, text in texts.items():
        mine = sorted(chunks.get(i, []), key=lambda r: r['index'])
        if "|" not in text:
            assert letters("".join(r.content for r in mine)) == letters(text)
        assert all(r.embedding_text for r in mine)
        for r in mine:
            assert chunker.count_tokens(r.content) <= 1024 or r.has_table or len(chunker.sentences(r.content)) == 1


def test_transcript_split(spark, sf):
    """The chunks of a transcript are its turns again, and the Operator begins a chunk."""
    turns, parts = {}, {}
    for r in QUERIES["transcript_parse"](spark, sf).orderBy("transcript_id", "n").collect():
        turns.setdefault(r.transcript_id, []).append((r.speaker, r.content))
    for r in QUERIES["transcript_split"](spark, sf).orderBy("transcript_id", "index").collect():
        assert all(s.speaker != "Operator" for s in r.sections[1:]) or r.sections[0].speaker == "Operator"
        parts.setdefault(r.transcript_id, []).extend((s.speaker, s.content) for s in r.sections)
    words = lambda t: [(s, w) for s, c in t for w in c.split()]
    assert {k: words(v) for k, v in turns.items()} == {k: words(v) for k, v in parts.items()}


def test_every_query_has_sql_or_a_test_here():
    assert set(QUERIES) - set(SQL) <= {"html_pages", "html_retention", "chunk_pack", "transcript_split"}


def test_sql_only_for_queries():
    assert set(SQL) <= set(QUERIES)
