import os
import time

import pytest
from pyspark.sql import functions as F

from folioquery.operators import schema as sc
from folioquery.operators import writes as wr
from folioquery.storage import WriteConflict, shared_dir

SPEC = sc.define("t", "id serial\nname text ! unique\nn integer default:7\ncreated_at timestamp ! default:CURRENT_TIMESTAMP\nupdated_at timestamp ! default:CURRENT_TIMESTAMP touch")


@pytest.fixture
def target(spark):
    return spark.sql("SELECT 1L AS id, 'a' AS name, 1L AS n, TIMESTAMP '2020-01-01' AS created_at, TIMESTAMP '2020-01-01' AS updated_at UNION ALL SELECT 2L, 'b', NULL, TIMESTAMP '2020-01-01', TIMESTAMP '2020-01-01'")


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_insert(spark, target):
    new = spark.createDataFrame([("c",), ("d",)], "name string")
    out = wr.insert(target, new, SPEC)
    assert rows(out.where("id > 2"), "id", "n") == [(3, 7), (4, 7)] and out.where("created_at IS NULL").count() == 0
    with pytest.raises(sc.SchemaError):
        wr.insert(target, new.withColumn("id", F.lit(9).cast("long")), SPEC)
    with pytest.raises(sc.NotNullError):
        wr.insert(target, spark.createDataFrame([(None,)], "name string"), SPEC)


def test_update_and_delete(target):
    out = wr.update_where(target, {"n": 5}, F.col("n") == 1, SPEC)
    assert rows(out, "id", "n") == [(1, 5), (2, None)]
    assert out.where("year(updated_at) > 2020").count() == 1
    with pytest.raises(sc.SchemaError):
        wr.update_where(target, {"id": 5}, F.lit(True), SPEC)
    assert rows(wr.delete_where(target, F.col("n") == 1), "id") == [(2,)]
    assert rows(wr.delete_where(target, F.col("n") != 1), "id") == [(1,), (2,)]


def test_upsert_is_idempotent(spark, target):
    src = spark.createDataFrame([(1, "z"), (9, "y")], "id long, name string").withColumn("created_at", F.current_timestamp())
    once = wr.upsert(target, src, ["id"])
    twice = wr.upsert(once, src, ["id"])
    assert rows(once, "id", "name", "n") == rows(twice, "id", "name", "n") == [(1, "z", 1), (2, "b", None), (9, "y", None)]
    assert once.where("id = 1 AND year(created_at) = 2020").count() == 1
    assert rows(wr.upsert_nothing(target, src, ["id"]), "id", "name") == [(1, "a"), (2, "b"), (9, "y")]
    assert rows(wr.upsert_partial(target, src, "id"), "id", "name") == [(1, "z"), (2, "b")]
    nulls = spark.createDataFrame([(2, None)], "id long, n long")
    assert rows(wr.upsert(wr.upsert(target, spark.createDataFrame([(2, 4)], "id long, n long"), ["id"]), nulls, ["id"]), "id", "n") == [(1, 1), (2, None)]
    wr.check_conflict_key(SPEC, ("name",))
    with pytest.raises(sc.SchemaError):
        wr.check_conflict_key(SPEC, ("n",))


def test_versions(spark, target, tmp_path):
    t = wr.VersionedTable(spark, f"file://{tmp_path}/t")
    t.provision(SPEC)
    assert t.read().count() == 0
    t.write(target)
    t.write(t.read().where("id = 1"))
    assert t.versions() == [1, 2, 3] and t.read().count() == 1 and t.read(2).count() == 2
    t.vacuum(1)
    assert t.versions() == [3]
    with pytest.raises(sc.SchemaError):
        wr.VersionedTable(spark, f"file://{tmp_path}/none").read()


def test_two_writers_lose_nothing(spark, target, tmp_path):
    at = f"file://{tmp_path}/t"
    a, b = wr.VersionedTable(spark, at), wr.VersionedTable(spark, at)
    a.write(target)
    before = a.versions()[-1]
    assert a.write(target.where("id = 1"), before) == 2
    with pytest.raises(WriteConflict):
        b.write(target.where("id = 2"), before)
    assert b.versions() == [1, 2] and rows(b.read(), "id") == [(1,)]
    assert not any("_stage" in x.name for x in (tmp_path / "t").rglob("*"))
    turn = []

    def late(now):  # another writer commits while this change is being made
        if not turn:
            turn.append(1)
            a.write(a.read().unionByName(target.where("id = 2")))
        return now.where("id = 2")

    assert b.change(late) == 4 and rows(b.read(), "id") == [(2,)]
    with pytest.raises(WriteConflict):
        b.change(lambda now: (a.write(target), now)[1], attempts=2)


def test_stages_of_dead_writers_go(spark, target, tmp_path):
    t = wr.VersionedTable(spark, f"file://{tmp_path}/t")
    t.write(target)
    for name, age in (("_stage-old", 100_000), ("_stage-new", 10)):
        (tmp_path / "t" / name).mkdir()
        os.utime(tmp_path / "t" / name, (time.time() - age,) * 2)
    t.vacuum()
    assert sorted(x.name for x in (tmp_path / "t").iterdir() if x.name.startswith("_stage")) == ["_stage-new"] and t.versions() == [1]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        get = staticmethod(lambda *_: None)

    class Context:
        getConf = staticmethod(lambda: Conf)

    class Session:
        conf, sparkContext = Conf, Context

    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        Context.master = master
        with pytest.raises(RuntimeError):
            shared_dir(Session)
