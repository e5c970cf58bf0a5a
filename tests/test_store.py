"""Opening, provisioning and migrating a store."""

import pytest

from folioquery.operators.schema import Catalog, SchemaError, define
from folioquery.operators.store import Store


def catalog(*more):
    out = Catalog().add_table(define("d", "id serial\ntitle text !\nnote text fts" + "".join(f"\n{m}" for m in more)))
    return out.add_table(define("c", "id serial\nd_id integer fk:d.id"))


def test_a_new_folder_is_provisioned_and_reopened(spark, tmp_path):
    at = f"file://{tmp_path}/s"
    store = Store(spark, at, catalog())
    assert store.load("d").count() == 0 and store.table("c").versions() == [1]
    rows = spark.createDataFrame([("a", "x"), ("b", None)], "title string, note string")
    assert store.commit("d", lambda q: q.insert(rows, ["title"])) == 2
    store.commit("d", lambda q: q.eq("title", "b").update({"note": "y"}))
    again = Store(spark, at, catalog())
    assert sorted((r.id, r.title, r.note) for r in again.load("d").collect()) == [(1, "a", "x"), (2, "b", "y")]
    assert [r.title for r in again.database.table("d").eq("note", "y").select("title").frame().collect()] == ["b"]


def test_another_schema_is_refused(spark, tmp_path):
    at = f"file://{tmp_path}/s"
    Store(spark, at, catalog())
    with pytest.raises(SchemaError, match="differs in d"):
        Store(spark, at, catalog("extra text"))
    for bad in ("relative/path", ":memory:", ""):
        with pytest.raises(SchemaError, match="absolute"):
            Store(spark, bad, catalog())


def test_migration_adds_what_may_be_null(spark, tmp_path):
    at = f"file://{tmp_path}/s"
    with pytest.raises(SchemaError, match="no store"):
        Store.migrate(spark, at, catalog())
    store = Store(spark, at, catalog())
    store.commit("d", lambda q: q.insert(spark.createDataFrame([("a",)], "title string"), ["title"]))
    for wrong in ("must text !",):
        with pytest.raises(SchemaError, match="cannot change"):
            Store.migrate(spark, at, catalog(wrong))
    with pytest.raises(SchemaError, match="cannot change"):
        Store.migrate(spark, at, Catalog().add_table(define("d", "id serial\ntitle text !")))
    new = Store.migrate(spark, at, catalog("extra text").add_table(define("e", "id serial")))
    assert new.load("d").first().extra is None and new.load("d").columns == ["id", "title", "note", "extra"] and new.load("e").count() == 0
    with pytest.raises(SchemaError):
        Store(spark, at, catalog())
