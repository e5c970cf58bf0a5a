"""Truth tables against SQLite, which defines LIKE, NULL and IN."""

import sqlite3

import pytest

from folioquery.operators.predicates import java_regex
from folioquery.operators.query import Database
from folioquery.operators.schema import Catalog, SchemaError, define

TEXTS = [(1, "apple"), (2, "APPLE pie"), (3, None), (4, ""), (5, "École"), (6, "a\\b"), (7, "10%_x"), (8, "éCOLE")]


@pytest.fixture(scope="module")
def db(spark):
    c = Catalog().add_table(define("t", "id serial\nx text fts")).add_table(define("j", "id serial\ntags json as:array<string>\nprops json"))
    rows = spark.createDataFrame(TEXTS, "id long, x string")
    j = spark.createDataFrame([(1, ["a", "b"], '{"k": 1}'), (2, [], "[1, \"1\"]"), (3, None, None), (4, ["1"], "5"), (5, ["A"], '["k", true]')], "id long, tags array<string>, props string")
    return Database(c, {"t": rows, "j": j}.__getitem__)


def ids(q):
    return sorted(r.id for r in q.select("id").frame().collect())


def sqlite(where):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE t (id INTEGER, x TEXT)")
    con.executemany("INSERT INTO t VALUES (?, ?)", TEXTS)
    return [r[0] for r in con.execute(f"SELECT id FROM t WHERE {where} ORDER BY id")]


@pytest.mark.parametrize("pattern", ["apple", "%pie", "école", "a\\b", "_pple", "10%"])
def test_ilike(db, pattern):
    full = pattern if "%" in pattern or "_" in pattern else f"%{pattern}%"
    assert ids(db.table("t").ilike("x", pattern)) == sqlite(f"x LIKE '{full}'")


def test_nulls(db):
    t = db.table("t")
    assert ids(t.neq("x", "apple")) == sqlite("x <> 'apple'")
    assert ids(t.eq("x", None)) == [3] and 3 not in ids(t.neq("x", None))
    assert ids(t.in_("x", [])) == [] and len(ids(t.not_in("x", []))) == len(TEXTS)
    assert ids(t.not_in("x", ["apple", None])) == sqlite("x NOT IN ('apple', NULL)") == []
    assert ids(t.in_("x", ["apple", None])) == [1]
    assert ids(t.between("id", None, None)) == ids(t) and ids(t.gt("id", None).lte("id", 2)) == [1, 2]


def test_regex(db):
    t = db.table("t")
    assert ids(t.regex("x", "^$")) == [3, 4]
    assert ids(t.regex("x", "ÉCOLE")) == [5, 8]
    assert ids(t.regex("x", "(")) == [] and java_regex("(") is None
    assert ids(t.regex("x", r"(?P<a>p)(?P=a)")) == [1, 2]


def test_contains(db):
    j = db.table("j")
    assert ids(j.contains("tags", "a")) == [1] and ids(j.contains("tags", ["A", "b"])) == [1, 5]
    assert ids(j.contains("tags", 1)) == [] and ids(j.contains("tags", [])) == []
    assert ids(j.contains("props", "k")) == [1, 5]
    assert ids(j.contains("props", 1)) == [2] and ids(j.contains("props", "1")) == [2] and ids(j.contains("props", True)) == [5]
    with pytest.raises(TypeError):
        j.contains("id", 1).select("id").frame()


def test_builder(db):
    with pytest.raises(SchemaError):
        db.table("nope")
    with pytest.raises(SchemaError):
        db.table("t").eq("nope", 1).select("id").frame()
    with pytest.raises(SchemaError):
        db.table("t").update({"id": 1})
    q = db.table("t").order("id", desc=True)
    assert [r.id for r in q.limit(5).limit(2).select("id").frame().collect()] == [8, 7]
    assert q.count().first()[0] == len(TEXTS)
    assert db.table("t").select("count(*) AS n, max(id) AS m").frame().first().asDict() == {"n": 8, "m": 8}
    assert [r.x for r in db.table("t").order("x").select("x").frame().collect()][0] is None


def test_writes_through_tables_and_never_through_views(spark, db, sf):
    from folioquery.plans.fixtures import database

    t = db.table("t")
    assert {r.id: r.x for r in t.eq("x", "apple").update({"x": "z"}).collect()} == {**dict(TEXTS), 1: "z"}
    assert sorted(r.id for r in t.is_null("x").delete().collect()) == [1, 2, 4, 5, 6, 7, 8]
    assert [r.id for r in t.insert(spark.createDataFrame([("new",)], "x string")).where("x = 'new'").collect()] == [9]
    assert {r.id: r.x for r in t.upsert(spark.createDataFrame([(2, "u"), (20, "v")], "id long, x string"), ["id"]).collect()} == {**dict(TEXTS), 2: "u", 20: "v"}
    with pytest.raises(SchemaError):
        t.upsert(spark.createDataFrame([("a",)], "x string"), ["x"])
    view = database(spark, sf).table("docs")
    for write in (lambda: view.insert(None), lambda: view.update({}), lambda: view.delete(), lambda: view.upsert(None, ["id"])):
        with pytest.raises(SchemaError):
            write()


def test_views_are_registered(spark, sf):
    from folioquery.plans.fixtures import database

    names = database(spark, sf).register_views()
    assert "filings_by_region" in names
    assert spark.sql("SELECT count(*) FROM filings_by_region").first()[0] == spark.read.parquet(f"{sf}/orders.parquet").count()
