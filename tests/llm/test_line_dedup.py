import numpy as np
import pytest
from compare import assert_same
from helpers import docs, empty

from folioquery.llm import kit, queries
from folioquery.llm import line_dedup as op

LONG = "this line is long enough to count as a key, É"


@pytest.mark.parametrize("name", ["op2_line_dedup", "op3_chat_format", "op8_token_rollup"])
def test_queries_against_sql(spark, sf, name):
    assert_same(spark, sf, queries.queries()[name], queries.oracle_sql()[name])


def test_perfect_hash():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 5000, dtype=np.uint64), rng.integers(0, 2**63, 5000, dtype=np.uint64)
    h = op.PerfectHash.build(a, b)
    assert sorted(h(a, b).tolist()) == list(range(5000))
    assert op.PerfectHash.build(a[:0], b[:0])(a[:2], b[:2]).tolist() == [-1, -1]


@pytest.mark.parametrize("mounted", [True, False])
def test_serving_files(tmp_path, monkeypatch, mounted):
    rng = np.random.default_rng(2)
    records = np.zeros(4000, op._RECORD)
    records["a"], records["b"] = rng.integers(0, 2**63, 4000, dtype=np.uint64), rng.integers(0, 2**63, 4000, dtype=np.uint64)
    records["docs"], records["last"] = np.arange(4000) % 9, np.arange(4000) - 50
    kit.put_file(f"file://{tmp_path}/serve-0", op._serving_file(records))
    if not mounted:
        monkeypatch.setattr(kit, "local_path", lambda uri: None)
    shard = op.Shard(op.Index(f"file://{tmp_path}", (4000,)), 0)
    assert sorted(shard.place(records["a"], records["b"]).tolist()) == list(range(4000))
    last, known = shard.last_of(records["a"], records["b"], 5)
    assert (known == (records["docs"] >= 5)).all() and (last[known] == records["last"][known]).all()
    assert not shard.last_of(records["b"], records["a"], 0)[1].any()


@pytest.mark.parametrize("size", [1 << 20, 60, 33])
def test_any_number_of_shards(spark, size):
    rows = [(i, f"{LONG.upper() if i % 2 else LONG}  \nshort\nown line of document number {i} is also long enough") for i in range(6)]
    rows += [(7, None), (8, ""), (9, f"{LONG}\n\t{LONG}\nx"), (None, f"a\n{LONG}")]
    out = op.drop_repeated_lines(docs(spark, rows).repartition(3), shard_bytes=size)
    assert out.columns[-3:] == ["n_lines", "n_dropped", "kept_text"] and out.columns.count("kept_text") == 2
    got = {r[0]: r[-3:] for r in map(tuple, out.collect())}
    # a key's É is not folded: upper-casing leaves it as it is, so all lines have one key
    assert got[9] == (3, 0, f"{LONG}\n\t{LONG}\nx") and got[7] == got[8] == (1, 0, "")
    assert got[None] == (2, 1, "a")
    assert all(got[i][:2] == (3, 1) for i in range(6))


def test_thresholds(spark):
    rows = [(i, "x" * 40 + "\n" + "y" * 39) for i in range(5)] + [(i, "é" * 40) for i in range(10, 14)]
    got = {r.doc_id: r.n_dropped for r in op.drop_repeated_lines(docs(spark, rows).select("doc_id", "text")).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 1, 4: 0, 10: 0, 11: 0, 12: 0, 13: 0}
    assert op.drop_repeated_lines(empty(spark)).collect() == []


def test_repeated_rows_count_each(spark):
    rows = [(1, LONG)] * 4 + [(2, LONG)]
    got = sorted((r.doc_id, r.n_dropped) for r in op.drop_repeated_lines(docs(spark, rows).select("doc_id", "text")).collect())
    assert got == [(1, 1)] * 4 + [(2, 0)]


def test_no_route_shuffles_or_broadcasts_texts(spark):
    rows = [(i, f"{LONG}\nline {i % 3} that is long enough to be a key of its own") for i in range(40)]
    df = docs(spark, rows)
    index = op.build_index(df, shard_bytes=40)
    assert len(index.sizes) == 4 and sum(index.sizes) == 4
    plan = op.drop_repeated_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
