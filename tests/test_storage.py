"""Commits that meet folds, other writers and clean-ups lose nothing."""

import os
import time

import pytest

from folioquery import storage
from folioquery.operators import writes as wr
from folioquery.operators.fulltext import TextIndex
from folioquery.storage import Log, WriteConflict


def frame(spark, keys, v="x"):
    return spark.createDataFrame([(k, k, f"{v} word{k}") for k in keys], "id long, ts long, text string")


def late(monkeypatch, of, name, work):
    """Let ``work`` happen once, just before ``of.name`` is called."""
    real, turn = getattr(of, name), []

    def first(*args, **kwargs):
        if not turn:
            turn.append(1)
            work()
        return real(*args, **kwargs)

    monkeypatch.setattr(of, name, first)


def test_merge_table_beside_append_and_fold(spark, tmp_path, monkeypatch):
    at = f"file://{tmp_path}/t"
    a, b = (wr.MergeTable(spark, at, frame(spark, [0]), "id", ["ts"]) for _ in range(2))
    b.append(frame(spark, [1]))

    def others():
        a.append(frame(spark, [2, 3]))
        a.fold()
        a.log.clean(0)

    late(monkeypatch, b.log, "finish", others)
    b.append(frame(spark, [10, 11, 12]))
    assert sorted(r.id for r in a.read().collect()) == [1, 2, 3, 10, 11, 12]


def test_versioned_table_beside_vacuum(spark, tmp_path, monkeypatch):
    at = f"file://{tmp_path}/t"
    a, b = wr.VersionedTable(spark, at), wr.VersionedTable(spark, at)
    a.write(frame(spark, [1]))

    def others():
        for k in (2, 3, 4):
            a.write(frame(spark, range(k)))
        a.vacuum(1)

    late(monkeypatch, b.folder, "finish", others)
    with pytest.raises(WriteConflict):
        b.write(frame(spark, range(100)), 1)
    assert a.versions() == [4] and a.read().count() == 4
    assert b.change(lambda now: now.unionByName(frame(spark, range(100, 200)))) == 5 and a.read().count() == 104


def test_text_index_beside_update_and_compact(spark, tmp_path, monkeypatch):
    at = f"file://{tmp_path}/i"
    a, b = TextIndex(spark, at), TextIndex(spark, at)
    a.update(frame(spark, [1, 2]), "id", "text")

    def others():
        a.update(frame(spark, [3]), "id", "text")
        a.compact()
        a.folder.clean(0)

    late(monkeypatch, b.folder, "finish", others)
    b.update(frame(spark, [2, 5, 6], "y"), "id", "text")
    assert tuple(a.statistics().first()) == (5, 10)
    assert sorted(r.key for r in a.postings(storage_token("y")).collect()) == [2, 5, 6] and [r.key for r in a.postings(storage_token("x")).orderBy("key").collect()] == [1, 3]


def storage_token(word):
    from pyspark.sql import functions as F

    return F.col("token") == word


def test_a_number_is_free_only_when_no_writer_can_ask_for_it(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/l")

    def part():
        with log.part() as p:
            frame(spark, [1]).write.parquet(f"{p.path}/rows")

    for _ in range(3):
        part()
    stage = log.begin()
    with log.base() as base:
        frame(spark, [1]).write.parquet(f"{base.path}/rows")
    assert log.live() == ["000000000003-base"] and log.begun(["000000000001"])  # running readers keep their files
    log.clean(hours=0)
    assert not log.begun(["000000000001"]) and "000000000001" in log.names() and not os.path.exists(f"{tmp_path}/l/000000000001/rows")
    with pytest.raises(WriteConflict):
        log.finish(stage, "000000000002")
    old = time.time() - 8 * 86400
    for name in (stage, "000000000001", "000000000002"):
        os.utime(tmp_path / "l" / name, (old, old))
    log.clean()
    assert "000000000001" not in log.names()
    with pytest.raises(WriteConflict):  # its stage has been swept, so the free number is no danger
        log.finish(stage, "000000000001")
    part()
    assert log.live() == ["000000000003-base", "000000000004"]


def test_conflicts_are_retried(monkeypatch):
    left = [2]

    def work():
        left[0] -= 1
        if left[0] >= 0:
            raise WriteConflict("x")
        return "done"

    assert storage.again(work) == "done"
    left[0] = 9
    with pytest.raises(WriteConflict):
        storage.again(work, 2)


def test_stores_that_copy_are_refused(spark):
    class Fs:
        getUri = staticmethod(lambda: type("U", (), {"getScheme": staticmethod(lambda: "s3a")}))

    class At:
        getFileSystem = staticmethod(lambda _: Fs)

    class Bucket(storage.Folder):
        def _at(self, name):
            return At

    with pytest.raises(ValueError, match="copies"):
        Bucket(spark, "s3a://b/t")


def test_rows_without_a_key_stay(spark):
    target = spark.createDataFrame([(1, "a"), (None, "n")], "id long, v string")
    rows = spark.createDataFrame([(1, "b"), (1, "c"), (None, "p"), (None, "q"), (2, "d"), (2, "e")], "id long, v string")
    want = [(1, "c"), (2, "e"), (None, "n"), (None, "p"), (None, "q")]
    assert sorted(map(tuple, wr.upsert(target, rows, ["id"]).collect()), key=repr) == sorted(want, key=repr)
    want = [(1, "a"), (2, "e"), (None, "n"), (None, "p"), (None, "q")]
    assert sorted(map(tuple, wr.upsert_nothing(target, rows, ["id"]).collect()), key=repr) == sorted(want, key=repr)


def test_newest_row_is_defined(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 4, "z")], "id long, ts long, v string")
    assert [tuple(r) for r in wr.newest_by(rows, "id", ["ts"]).collect()] == [(1, 5, "b")]
