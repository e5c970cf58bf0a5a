"""The substring index names every row that a pattern matches, and hardly any other."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioquery.operators import substrings as sub
from folioquery.operators.predicates import And, Leaf, Or
from folioquery.operators.query import Database
from folioquery.operators.schema import Catalog, define
from folioquery.plans.fixtures import database

TEXTS = ["The quick brown fox", "quick\nsilver", "THE THEATRE", "", None, "naïve café ÉTÉ", "aaa bbb ccc " * 50, "Kelvin Kelvin", "ſtrange straße", "a%b_c", "x" * 5000 + "needle" + "y" * 5000, "ıİ point POINT"]
PATTERNS = [
    r"quick", r"th(e|at)", r"(quick|slow)\s+(brown|silver)", r"^the\b", r"ne+dle", r"need(le)?", r"(?:aaa|bbb) (ccc)+", r"\bcaf\w", r"kelvin", r"strange", r"p[oi]int", r"point", r"a.b", r"(?=quick)q", r"(?!quick)the", r"x{3}", r"(abc){0}quick", r"", r"[", r"(a)\1", r"(?P<w>bbb) ccc", r"été", r"ÉTÉ", r"(?-i:THE) ",
]


def holds(need, text):
    """The tree applied to a folded text."""
    if need is None:
        return True
    text = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZKſıİ", "abcdefghijklmnopqrstuvwxyzksii"))
    if need.kind == "literal":
        return need.parts[0] in text
    return (any if need.kind == "one" else all)(holds(p, text) for p in need.parts)


@pytest.mark.parametrize("pattern", PATTERNS)
def test_what_matches_holds_what_is_needed(pattern):
    need = sub.need_of_regex(pattern)
    try:
        of = re.compile(pattern, re.IGNORECASE)
    except re.error:
        assert need is None
        return
    assert all(holds(need, t) for t in TEXTS if of.search(t or ""))


@settings(max_examples=300, deadline=None)
@given(st.recursive(st.sampled_from(["abc", "abd", "b", "c+", "[ab]", ".", "\\b", "d?", "é"]), lambda x: st.one_of(st.tuples(x, x).map("".join), st.tuples(x, x).map("({0[0]}|{0[1]})".format), x.map("(?:{})*".format), x.map("({}){{1,2}}".format), x.map("(?={})".format)), max_leaves=8), st.text(alphabet="abcdé ABC", max_size=30))
def test_needs_of_random_patterns(pattern, text):
    if re.search(pattern, text, re.IGNORECASE):
        assert holds(sub.need_of_regex(pattern), text)


def test_needs():
    assert sub.need_of_regex("(foo|bar)baz") == sub.Need("all", (sub.Need("one", (sub.Need("literal", ("foo",)), sub.Need("literal", ("bar",)))), sub.Need("literal", ("baz",))))
    assert sub.need_of_regex("th(e|at)").kind == "one" and sub.need_of_regex("a|b+") is None and sub.need_of_like("%AbC_d%") == sub.Need("literal", ("abc",))
    both = And((Leaf("regex", "t", "abc"), Or((Leaf("regex", "t", "xyz"), Leaf("eq", "t", "q"))), Leaf("ilike", "u", "def")))
    assert [f for f, _ in sub.need_of(both)] == ["t", "u"]
    assert len(sub.grams_of("x" * 100)) <= sub.GRAMS


@pytest.fixture
def db(spark, tmp_path):
    rows = spark.createDataFrame([(i - 3, t) for i, t in enumerate(TEXTS * 30)], "id long, content text".replace("text", "string"))
    index = sub.SubstringIndex(spark, f"file://{tmp_path}/s")
    index.update(rows, "id", "content")
    spec = Catalog().add_table(define("d", "id serial\ncontent text fts"))
    return Database(spec, lambda _: rows, substrings=lambda t, c: index), Database(spec, lambda _: rows), index, rows


def test_same_rows_as_a_scan(spark, db):
    with_index, scan, index, rows = db
    for pattern in PATTERNS:
        got, want = (sorted(r.id for r in x.table("d").regex_search(pattern).select("id").frame().collect()) for x in (with_index, scan))
        assert got == want, pattern
    for like in ("QUICK", "%the%", "a_b", "ne_dle%", "café", "zzzz"):
        got, want = (sorted(r.id for r in x.table("d").ilike("content", like).select("id").frame().collect()) for x in (with_index, scan))
        assert got == want, like
    assert index.candidates(sub.need_of_regex("needle")).count() == 30
    wide = sorted(r.id for r in index.narrow(rows, "id", sub.need_of_regex("needle")).collect())
    sub_named, sub.NAMED = sub.NAMED, 5
    try:
        assert sorted(r.id for r in index.narrow(rows, "id", sub.need_of_regex("needle")).collect()) == wide
    finally:
        sub.NAMED = sub_named


def test_updates_and_folds(spark, tmp_path):
    index = sub.SubstringIndex(spark, f"file://{tmp_path}/s")
    frame = lambda rows: spark.createDataFrame(rows, "id long, t string")
    index.update(frame([(1, "alpha"), (2, "beta"), (None, "alpha")]), "id", "t")
    index.update(frame([(2, "alphabet"), (3, "gamma")]), "id", "t")
    keys = lambda p: sorted(r.key for r in index.candidates(sub.need_of_regex(p)).collect())
    before = [keys(p) for p in ("alpha", "beta", "gam", "bet")]
    assert before == [[1, 2], [2], [3], [2]]
    index.fold()
    index.fold()
    assert [keys(p) for p in ("alpha", "beta", "gam", "bet")] == before and len(index.log.live()) == 1
    assert sub.SubstringIndex(spark, f"file://{tmp_path}/none").candidates(sub.need_of_regex("abc")).count() == 0


def test_only_candidates_reach_the_pattern(spark, sf):
    frame = database(spark, sf).table("docs").regex_search(r"\bidiot\b", "content").select("id").frame()
    want = frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan") :]
    assert "In(doc_id" in scan and "rlike" in plan.lower()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    named = database(spark, sf).substrings("documents", "text").candidates(sub.need_of_regex(r"\bidiot\b")).count()
    assert len(want) <= named < docs.count() / 2
    assert sorted(r.id for r in want) == sorted(r.doc_id for r in docs.where(F.col("text").rlike(r"(?i)\bidiot\b")).collect())


def test_texts_are_not_shuffled_to_the_rows_that_are_named(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 30)], "id long, t string")
    index = sub.SubstringIndex(spark, f"{tmp_path}/index")
    monkeypatch.setattr(sub, "GROUPED", 50)
    index.update(rows, "id", "t")
    ranges = {f for f in index._read(index.log.live()).inputFiles()}
    assert len(ranges) > 10  # as many ranges as the postings ask for
    need = sub.need_of_regex("quick")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for named, sent in ((1000, 1000), (1, 1000), (1, 1)):
            monkeypatch.setattr(sub, "NAMED", named)
            monkeypatch.setattr(sub, "SENT", sent)
            found = index.narrow(rows, "id", need)
            assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
            assert {r.id for r in found.where(F.col("t").rlike("(?i)quick")).collect()} == {i for i, t in enumerate(TEXTS * 30) if "quick" in (t or "")}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
