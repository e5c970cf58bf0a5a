"""BM25 against SQLite's own full-text index, and the intents of ranking tests."""

import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioquery.functions import text as tx
from folioquery.operators.query import Database
from folioquery.operators.schema import Catalog, SchemaError, define

DOCS = [(1, "apple banana cherry"), (2, "apple banana"), (3, "apple"), (4, "Crème brûlée, no fruit"), (5, "revenue-growth guidance 2025"), (6, "test1 tests test"), (7, None)]


@pytest.fixture(scope="module")
def db(spark):
    rows = spark.createDataFrame(DOCS, "id long, content string")
    return Database(Catalog().add_table(define("d", "id serial\ncontent text fts")), lambda _: rows)


def fts5(match):
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE f USING fts5(content, tokenize='unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5 here")
    con.executemany("INSERT INTO f(rowid, content) VALUES (?, ?)", [(i, x or "") for i, x in DOCS])
    return {r[0]: -r[1] for r in con.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ? ORDER BY bm25(f), rowid", (match,))}


@pytest.mark.parametrize(("query", "match"), [("banana cherry", '"banana"* OR "cherry"*'), ("tes", '"tes"*'), ("creme", '"creme"*'), ("revenue-growth", '"revenue growth"'), ("FY2025", '"fy" OR "2025"*')])
def test_bm25_like_fts5(db, query, match):
    got = {r.id: r._score for r in db.table("d").keyword_search(query).select("id").frame().collect()}
    want = fts5(match)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-9)


def test_shorter_documents_rank_first(db):
    found = db.table("d").keyword_search("cherry banana").select("id").frame().collect()
    assert all(r._score > 0 for r in found)
    assert [r.id for r in db.table("d").fts("apple", "content").select("id").frame().collect()] == [3, 2, 1]


def test_phrase_needs_neighbours(db):
    assert [r.id for r in db.table("d").fts("banana cherry").select("id").frame().collect()] == [1]
    assert db.table("d").fts("cherry banana").select("id").frame().count() == 0
    assert db.table("d").keyword_search("").select("id").frame().count() == 0


def test_overlapping_phrases(spark):
    row = spark.sql("SELECT array('a', 'a', 'a', 'b') AS k, array('a') AS one").select(tx.occurrences(F.col("k"), tx.Term(("a", "a"))), tx.occurrences(F.col("one"), tx.Term(("a", "a")))).first()
    assert tuple(row) == (2, 0)


def test_parser():
    assert tx.parse_keywords("FY2025 ab") == [tx.Term(("fy",)), tx.Term(("2025",), True), tx.Term(("ab",))]
    assert tx.parse_keywords('"year-over-year"') == [tx.Term(("year", "over", "year"))]
    assert tx.parse_keywords("$ * !") == []


def test_column_must_be_clear(spark):
    two = Database(Catalog().add_table(define("d", "id serial\na text fts\nb text fts")), None)
    with pytest.raises(SchemaError):
        two.table("d").keyword_search("x")


@settings(max_examples=20, deadline=None)
@given(st.text(alphabet="aZé ß-09_.Ñ", max_size=20))
def test_analyzer_matches_python(spark, text):
    got = spark.createDataFrame([(text,)], "x string").select(tx.tokens(F.col("x"))).first()[0]
    assert tuple(got) == tx.analyze(text)


def test_formats(spark):
    row = spark.sql("SELECT 1234567890.0D AS a, 0.0D AS b, -2500.0D AS c, '1231' AS d, 'x' AS e, 3.1e12D AS f")
    got = row.select(tx.format_value(F.col("a")), tx.format_value(F.col("b")), tx.format_value(F.col("c")), tx.format_year_end(F.col("d")), tx.format_year_end(F.col("e")), tx.format_market_cap(F.col("f"))).first()
    assert tuple(got) == ("$1.235B", "-", "$-2.500K", "December 31", "x", "$3.1T")
    assert tx.expand_forms(["10-K", "8-K/A"]) == ["10-K", "10-K/A", "8-K/A"]


def test_weighted_columns_like_fts5(spark):
    rows = [(1, "apple pie", "banana"), (2, "plain", "apple apple"), (3, "none", "none at all"), (4, "x", "y z")]
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE f USING fts5(a, b)")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5 here")
    con.executemany("INSERT INTO f(rowid, a, b) VALUES (?, ?, ?)", rows)
    want = dict(con.execute("SELECT rowid, bm25(f, 10.0, 5.0) FROM f WHERE f MATCH 'apple'").fetchall())
    df = spark.createDataFrame(rows, "id long, a string, b string")
    got = {r.id: r.rank for r in tx.bm25(df, "id", {"a": 10.0, "b": 5.0}, [tx.Term(("apple",))]).collect()}
    assert got == {k: pytest.approx(v, rel=1e-9) for k, v in want.items()}


def _index(spark, tmp_path, rows):
    from folioquery.operators.fulltext import TextIndex

    index = TextIndex(spark, f"file://{tmp_path}/i")
    index.update(spark.createDataFrame(rows, "id long, t string"), "id", "t")
    return index


def test_best_k_are_those_of_a_full_ranking(spark, tmp_path):
    import random

    rng = random.Random(3)
    rows = [(i - 200, " ".join(rng.choices(["common", "comma", "rare", "odd", "x"], weights=[30, 5, 0.3, 3, 40], k=rng.randint(1, 40)))) for i in range(1500)]
    rows += [(5000, "rare " * 20), (5001, "rare " * 20), (5002, None)]
    index = _index(spark, tmp_path, rows)
    terms = [[tx.Term(("rare",))], [tx.Term(("com",), True), tx.Term(("rare",))], [tx.Term(("none",))], [tx.Term(("x",)), tx.Term(("odd",))], [tx.Term(("odd", "x")), tx.Term(("rare",))], []]
    for some in terms:
        for k in (1, 3, 40, 5000):
            order = ["rank", "id"]
            want = index.bm25(some).orderBy(*order).limit(k).collect()
            got = index.best(some, k).orderBy(*order).limit(k).collect()
            assert [(r.id, round(r.rank, 9)) for r in got] == [(r.id, round(r.rank, 9)) for r in want], (some, k)


def test_blocks_that_cannot_hold_a_best_document_are_not_read(spark, tmp_path):
    rows = [(i, "common " * (9 if i // 64 == 7 else 1) + "filler " * (i % 5 + 3)) for i in range(6400)]
    index = _index(spark, tmp_path, rows)
    term = [tx.Term(("common",))]
    found = index.best(term, 10)
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 64 < index.postings(F.col("token") == "common").count() == 6400
    assert "In(run" in scan.replace(" ", "") or "EqualTo(run" in scan.replace(" ", "")


def test_an_index_that_awaits_compaction_ranks_all(spark, tmp_path):
    index = _index(spark, tmp_path, [(1, "a b"), (2, "a")])
    index.update(spark.createDataFrame([(2, "b b"), (3, "a")], "id long, t string"), "id", "t")
    ranks = lambda: sorted((r.id, round(r.rank, 9)) for r in index.best([tx.Term(("a",))], 1).collect())
    before = ranks()
    index.compact()
    assert [i for i, _ in before] == [1, 3] and set(ranks()) <= set(before)


def test_a_run_of_documents_becomes_one_block_a_token(spark, tmp_path):
    """The rows that an index shuffles and stores are tokens of runs, not postings of 64 keys."""
    index = _index(spark, tmp_path, [(i, "common filler") for i in range(2048)])
    stored = spark.read.parquet(f"file://{tmp_path}/i/000000000001/blocks")
    assert stored.groupBy("token").count().orderBy("token").collect() == [("common", 2), ("filler", 2)]
    assert index.postings(F.col("token") == "common").count() == 2048


def test_blocks_hold_every_posting_whatever_the_batches(spark, tmp_path):
    """Runs cut by batches, repeated and negative keys, empty texts; replaced, emptied and deleted documents; then compacted."""
    import random
    from collections import Counter

    rng = random.Random(5)
    texts = {i: " ".join(rng.choices(["of", "the", "a", "rare", "odd"], k=rng.randint(0, 30))) for i in [*range(-70, 200), *range(5000, 5100), 10**12, -(10**12)]}
    texts[7] = " ".join(f"w{i}" for i in range(70)) + " of the w69"
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        index = _index(spark, tmp_path, [*texts.items(), (3, ""), (-4, None), (None, "of")])
        change = {k: "of the new" for k in texts if k % 3 == 0} | {k: "" for k in texts if k % 3 == 1 and k % 5 == 0}
        change[900] = "of of the"
        index.update(spark.createDataFrame([(k, v or None) for k, v in change.items()], "id long, t string"), "id", "t")
        gone = [k for k in texts if k % 11 == 0] + [123456]
        index.delete(spark.createDataFrame([(k,) for k in gone], "id long"), "id")
        want = {k: v.split() for k, v in (texts | change).items() if k not in gone}
        postings = sorted((t, k, n, len(v), [i for i, x in enumerate(v) if x == t]) for k, v in want.items() for t, n in Counter(v).items())
        for _ in range(2):
            assert tuple(index.statistics().first()) == (len(want), sum(map(len, want.values())))
            assert sorted((r.token, r.key, r.tf, r.n, r.positions) for r in index.postings(F.lit(True)).collect()) == postings
            index.compact()
        heads = index._blocks(index.folder.live()).where("size(keys) >= 32").select("token", F.inline("heads"), "keys", "tfs").where("bit_count(bits) <> size(filter(keys, k -> shiftright(k, 6) = piece))")
        assert heads.count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_an_index_leaves_no_shuffle_files(spark, tmp_path):
    import gc

    held = lambda: sum(f.getName().startswith("shuffle_") for f in files())
    files = lambda: spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())
    gc.disable()  # what is left to the collector stays
    try:
        before = held()
        index = _index(spark, tmp_path, [(i, f"common w{i}") for i in range(3000)])
        index.delete(spark.createDataFrame([(5,), (7,)], "id long"), "id")
        index.compact()
        assert held() <= before
    finally:
        gc.enable()
    assert index.postings(F.col("token") == "common").count() == 2998
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_blocks_move_packed_and_without_what_is_taken_back(spark, tmp_path, monkeypatch):
    """What goes through the shuffle of a compaction, with no broadcast by Spark's own estimate: blocks as bytes, once, the row of a run's changed keys not beside each."""
    from folioquery.operators.fulltext import TextIndex

    plans, sort = [], TextIndex._sorted
    monkeypatch.setattr(TextIndex, "_sorted", staticmethod(lambda blocks: plans.append(blocks) or sort(blocks)))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = _index(spark, tmp_path, [(i, "common filler " * 20) for i in range(3000)])
        index.update(spark.createDataFrame([(i, "common new") for i in range(0, 3000, 3)], "id long, t string"), "id", "t")
        index.compact()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert all(p.columns == ["token", "run", "packed"] for p in plans) and len(plans) == 3
    assert sum(index.postings(F.col("token") == t).count() for t in ("common", "filler", "new")) == 3000 + 2000 + 1000


def test_blocks_sorted_in_passes_are_the_same(spark, tmp_path, monkeypatch):
    from folioquery.operators import fulltext

    texts = [(i, " ".join(f"{w}{(i * k) % 97}" for k, w in enumerate("of the é 漢 𝒳 a zz".split()))) for i in range(2000)]
    found = []
    for bytes_of_a_pass in (1 << 40, 1):
        monkeypatch.setattr(fulltext, "_PASS_BYTES", bytes_of_a_pass)
        index = _index(spark, tmp_path / str(bytes_of_a_pass), texts)
        index.update(spark.createDataFrame([(3, "of0 new"), (4, None), (9999, "zz")], "id long, t string"), "id", "t")
        each = lambda: sorted(map(str, index.postings(F.lit(True)).collect()))  # noqa: B023, E731
        found.append(each())
        index.compact()
        assert each() == found[-1]
        assert index._blocks(index.folder.live()).groupBy("token", "run").count().where("count > 1").count() == 0
    assert found[0] == found[1] and len(found[0]) > 2000
    many = fulltext.TextIndex(spark, f"file://{tmp_path}/1/i")
    blocks = many._blocks(many.folder.live())
    ranges = many._passes(blocks, F.size("keys"), [f"{n}/blocks" for n in many.folder.live()])
    assert len(ranges) == 4 and blocks.where(sum((r.cast("int") for r in ranges), F.lit(0)) != 1).count() == 0


def test_packed_blocks_come_back():
    import numpy as np

    from folioquery.operators.fulltext import _packed, _unpacked

    rng = np.random.default_rng(2)
    count = rng.integers(1, 30, 50)
    first = np.cumsum(count) - count
    key = np.concatenate([np.sort(rng.choice(1024, c, replace=False)) - 2048 for c in count])
    tf, n = rng.choice([1, 2, 300], len(key)), rng.integers(1, 2**31 - 1, len(key))
    places = np.concatenate([np.sort(rng.integers(0, 2**31 - 1, k)) for k in tf])
    for got, want in zip(_unpacked(_packed(first, key, tf, n, places)), (count, key & 1023, tf, n, places), strict=True):
        assert (got == want).all()


def test_order_of_more_tokens_than_a_digit_holds():
    import numpy as np

    from folioquery.operators.fulltext import _order

    codes = np.random.default_rng(1).integers(0, 200_000, 50_000)
    assert (_order(codes, 200_000) == np.argsort(codes, kind="stable")).all()
