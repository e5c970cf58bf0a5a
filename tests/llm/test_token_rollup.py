import pytest
from helpers import docs

from folioquery.llm import queries
from folioquery.llm import token_rollup as op
from folioquery.storage import WriteConflict


def totals(store):
    return {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens) for r in store.totals().collect()}


def test_deltas_follow_changes(spark, tmp_path):
    s = op.RollupStore(spark, f"file://{tmp_path}/r")
    assert s.totals().collect() == []
    df = docs(spark, [(1, "a b"), (2, "c"), (2, "c"), (3, None), (None, "x y z")])
    assert s.commit("b1", op.counts(df, "words-1"))
    assert totals(s) == {("s", "en", "words-1"): (4, 6)}
    assert not s.commit("b1", op.counts(df, "words-1")) and totals(s) == {("s", "en", "words-1"): (4, 6)}
    revised = docs(spark, [(1, "a b c d"), (2, "c")])
    s.commit("b2", op.counts(revised, "words-1"))
    assert totals(s) == {("s", "en", "words-1"): (4, 8)}
    s.commit("b3", deletes=spark.createDataFrame([(1,), (1,), (77,), (None,)], "doc_id long"))
    assert totals(s) == {("s", "en", "words-1"): (3, 4)}
    s.commit("b4", op.counts(docs(spark, [(1, "back")]), "words-1"))
    s.commit("b5", op.counts(docs(spark, [(1, "a-b")]), "alnum-2"))
    want = {("s", "en", "words-1"): (4, 5), ("s", "en", "alnum-2"): (1, 2)}
    assert totals(s) == want
    s.commit("none", op.counts(docs(spark, []), "words-1"))
    s.compact()
    assert totals(s) == want and len(s._live()) == 1 and {r.batch_id for r in s.committed().collect()} == {"b1", "b2", "b3", "b4", "b5", "none"}
    assert not s.commit("b2", op.counts(revised, "words-1"))
    s.commit("b6", deletes=spark.createDataFrame([(1, "alnum-2")], "doc_id long, tokenizer string"))
    assert totals(s) == {("s", "en", "words-1"): (4, 5)}


def test_a_document_moves_between_groups(spark, tmp_path):
    s = op.RollupStore(spark, f"file://{tmp_path}/r")
    s.commit("1", op.counts(docs(spark, [(1, "a b")]), "words-1"))
    moved = op.counts(docs(spark, [(1, "a b c")]), "words-1").selectExpr("doc_id", "tokenizer", "cast(null as string) AS source", "lang", "tokens")
    s.commit("2", moved)
    assert totals(s) == {(None, "en", "words-1"): (1, 3)}


def test_unfinished_batches_do_not_count(spark, tmp_path):
    s = op.RollupStore(spark, f"file://{tmp_path}/r")
    (tmp_path / "r" / "_stage-lost" / "delta").mkdir(parents=True)
    s.commit("1", op.counts(docs(spark, [(1, "a")]), "words-1"))
    assert totals(s) == {("s", "en", "words-1"): (1, 1)}
    with pytest.raises(ValueError):
        s.commit("")


def test_compaction_of_many_batches_with_long_ids(spark, tmp_path):
    """A thousand ids of 130 characters, of which three are batches with rows."""
    s = op.RollupStore(spark, f"file://{tmp_path}/r")
    name = lambda k: "a/~" * 42 + f"{k:04d}"
    s.commit(name(0), op.counts(docs(spark, [(1, "a b")]), "words-1"))
    parts = {x: (tmp_path / "r" / f"{1:012d}" / x) for x in ("ids", "delta", "state")}
    import pyarrow as pa
    import pyarrow.parquet as pq

    for k in range(2, 999):  # batches without changes, written as commit would
        for x, of in parts.items():
            at = tmp_path / "r" / f"{k:012d}" / x
            at.mkdir(parents=True)
            if x == "ids":
                pq.write_table(pa.table({"batch_id": [name(k)], "seq": [k]}), at / "part.parquet")
            else:
                schema = pq.read_schema(next(of.glob("*.parquet")))
                pq.write_table(schema.empty_table(), at / "part.parquet")
    assert s.commit(name(999), op.counts(docs(spark, [(1, "a b c"), (2, "d")]), "words-1"))
    assert not s.commit(name(500), op.counts(docs(spark, [(3, "e")]), "words-1"))
    want = {("s", "en", "words-1"): (2, 4)}
    assert totals(s) == want
    s.compact()
    assert totals(s) == want and len(s._live()) == 1 and s.committed().count() == 999
    assert not s.commit(name(2)) and s.commit("new", op.counts(docs(spark, [(2, None)]), "words-1"))
    assert totals(s) == {("s", "en", "words-1"): (2, 3)}


def test_two_writers(spark, tmp_path, monkeypatch):
    a, b = (op.RollupStore(spark, f"file://{tmp_path}/r") for _ in range(2))
    write = b._write

    def late(*args):  # the other one commits while this batch is being written
        a.commit("first", op.counts(docs(spark, [(1, "a b c")]), "words-1"))
        write(*args)

    monkeypatch.setattr(b, "_write", late)
    with pytest.raises(WriteConflict):
        b.commit("second", op.counts(docs(spark, [(1, "z")]), "words-1"))
    monkeypatch.undo()
    assert totals(b) == {("s", "en", "words-1"): (1, 3)}
    assert b.commit("second", op.counts(docs(spark, [(1, "z")]), "words-1")) and totals(a) == {("s", "en", "words-1"): (1, 1)}


def test_columns_that_clash(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b", "s", "en", "x", 9, 1)], "doc_id long, text string, source string, lang string, tokenizer string, tokens long, live int")
    s = op.RollupStore(spark, f"file://{tmp_path}/r")
    s.commit("1", op.counts(rows, "words-1"))
    assert totals(s) == {("s", "en", "words-1"): (1, 2)}
    s.commit("2", deletes=rows.drop("tokenizer"))
    assert totals(s) == {}


def test_query_revises_every_count(spark, sf, monkeypatch):
    stores, made = [], op.RollupStore

    def kept(*args):
        stores.append(made(*args))
        return stores[-1]

    monkeypatch.setattr(op, "RollupStore", kept)
    queries.op8_token_rollup(spark, sf).collect()
    states = stores[0]._read("state", op.STATE).where("live AND tokenizer = 'words-1'")
    found = states.groupBy("doc_id").agg({"seq": "count"}).collect()
    assert len(found) == spark.read.parquet(f"{sf}/documents.parquet").count() and all(r[1] == 2 for r in found)
    assert states.groupBy("doc_id", "source", "lang", "tokens").count().count() == 2 * len(found)


def test_a_batch_beside_another_and_compaction(spark, tmp_path, monkeypatch):
    """A number that compaction covers is not free again: the slow batch conflicts, and its retry counts."""
    a, b = (op.RollupStore(spark, f"file://{tmp_path}/r") for _ in range(2))
    a.commit("0", op.counts(docs(spark, [(9, "a")]), "words-1"))
    finish, turn = b.folder.finish, []

    def late(*args):
        if not turn:
            turn.append(1)
            a.commit("first", op.counts(docs(spark, [(1, "a b c")]), "words-1"))
            a.compact()
            a.folder.clean(0)
        return finish(*args)

    monkeypatch.setattr(b.folder, "finish", late)
    batch = op.counts(docs(spark, [(1, "z"), (2, "y x")]), "words-1")
    with pytest.raises(WriteConflict):
        b.commit("slow", batch)
    assert totals(a) == {("s", "en", "words-1"): (2, 4)} and len(a.folder.live()) == 1
    assert b.commit("slow", batch) and not b.commit("slow", batch)
    assert totals(a) == {("s", "en", "words-1"): (3, 4)} and a.committed().count() == 3
