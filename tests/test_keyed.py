"""A change rewrites the files that can hold its keys, and gives the rows of the plain operation."""

import pytest

from folioquery.operators import keyed, writes
from folioquery.operators.keyed import KeyedTable
from folioquery.storage import WriteConflict


def frame(spark, keys, v="x"):
    return spark.createDataFrame([(k, f"{v}{k}", k % 3) for k in keys], "k long, v string, n long")


@pytest.fixture
def table(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", "k", per_file=50)
    t.create(frame(spark, range(0, 2000, 2)))
    return t


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_one_key_reads_and_rewrites_one_file(spark, table):
    before = {r.file for r in table._directory().collect()}
    assert len(before) >= 15
    assert table._touched(frame(spark, [842]))[0] == table.upsert(frame(spark, [842], "new"))
    after = {r.file for r in table._directory().collect()}
    assert len(before - after) == 1 and len(before & after) == len(before) - 1
    assert table.fetch([842]).first().v == "new842" and table.read().count() == 1000
    files = table.fetch([842]).inputFiles()
    assert len(files) == 1
    assert table.fetch([]).count() == 0 and table.fetch([5]).count() == 0


def test_changes_are_those_of_the_plain_operations(spark, table):
    old = table.read()
    old_rows = spark.createDataFrame(old.collect(), old.schema)
    change = frame(spark, [3, 4, 4, 1999, 5000, -7], "c").select("k", "v")
    want = rows(writes.upsert(old_rows, change, ["k"]))
    table.upsert(change)
    assert rows(table.read()) == want
    part = frame(spark, [4, 9999], "p").select("k", "v")
    want = rows(writes.upsert_partial(spark.createDataFrame(want, old.schema), part, "k"))
    table.upsert_partial(part)
    assert rows(table.read()) == want
    touched = table.delete(frame(spark, [10, 12, 12, 777777]))
    assert rows(table.read()) == [r for r in want if r[0] not in (10, 12)] and len(touched) <= 2
    with pytest.raises(ValueError):
        table.upsert(spark.createDataFrame([(None, "x")], "k long, v string"))


def test_many_keys_by_ranges(spark, table, monkeypatch):
    monkeypatch.setattr(keyed, "NAMED", 20)
    table.upsert(frame(spark, range(100, 400), "m"))
    got = {r.k: r.v for r in table.read().collect()}
    assert len(got) == 1150 and got[101] == "m101" and got[98] == "x98"


def test_old_versions_can_be_read_until_vacuum(spark, table):
    reader = table.read()
    table.upsert(frame(spark, [842], "new"))
    assert reader.where("k = 842").first().v == "x842"
    table.delete(frame(spark, range(0, 2000)))
    assert table.read().count() == 0 and table.vacuum() == []
    assert table.vacuum(hours=0)
    table.upsert(frame(spark, [1]))
    assert rows(table.read()) == [(1, "x1", 1)]


def test_two_writers_of_one_state(spark, tmp_path, table, monkeypatch):
    other = KeyedTable(spark, table.root, "k", per_file=50)
    real, turn = table._store, []

    def late(*args):
        if not turn:
            turn.append(1)
            other.upsert(frame(spark, [1], "other"))
        return real(*args)

    monkeypatch.setattr(table, "_store", late)
    table.upsert(frame(spark, [3], "mine"))  # made again after the conflict
    got = {r.k: r.v for r in table.read().collect()}
    assert got[1] == "other1" and got[3] == "mine3" and len(got) == 1002
    turn.clear()
    with pytest.raises(WriteConflict):
        table.upsert(frame(spark, [5]), attempts=1)
