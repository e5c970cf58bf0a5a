"""Exact top-k from groups: the same rows as a full search, and fewer vectors."""

import numpy as np
import pytest

from folioquery.operators import vector
from folioquery.operators.pivots import PivotIndex


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, vector array<float>")


def same(spark, index, rows, query, k, ids=None):
    wanted = rows if ids is None else rows.join(ids, "id", "left_semi")
    want = [(r.id, round(r.score, 6)) for r in vector.top_k(wanted, "id", "vector", query, k).collect()]
    assert [(r.id, round(r.score, 6)) for r in index.search(query, k, ids).collect()] == want


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(12, 16))
    v = centre[rng.integers(0, 12, 6000)] + 0.05 * rng.normal(size=(6000, 16))
    v[100:400] = v[100]  # ties
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    bad = [(7001, None), (7002, [float("nan")] * 16), (7003, [float("inf")] * 16), (7004, [1.0] * 3), (7005, [0.0] * 16), (7006, []), (7007, [None] + [1.0] * 15)]
    df = frame(spark, rows + bad).cache()
    index = PivotIndex(spark, f"file://{tmp_path_factory.mktemp('p')}/i")
    index.build(df)
    return index, df, v


def test_same_rows_as_a_full_search(spark, clustered):
    index, df, v = clustered
    for q, k in ((v[5], 10), (v[100], 50), (-v[7], 5), (np.zeros(16), 3), (np.ones(16), 400)):
        same(spark, index, df, q.tolist(), k)
    ids = df.where("id % 97 = 3").select("id")
    same(spark, index, df, v[5].tolist(), 20, ids)
    same(spark, index, df, v[5].tolist(), 200, ids)


def test_most_vectors_are_not_read(spark, clustered):
    index, df, v = clustered
    groups, share = index.groups(v[5].tolist(), 10)
    assert groups and share < 0.35
    plan = index.search(v[5].tolist(), 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [grp" in plan.replace("PartitionFilters: [isnotnull(grp#", "PartitionFilters: [grp").replace("INSET", "IN") or "PartitionFilters: [" in plan and "grp" in plan


def test_empty_and_rebuilt(spark, tmp_path):
    index = PivotIndex(spark, f"file://{tmp_path}/i")
    index.build(frame(spark, []))
    assert index.search([1.0, 0.0], 3).collect() == []
    index.build(frame(spark, [(1, [1.0, 0.0]), (2, [0.0, 0.0])]))
    assert [r.id for r in index.search([1.0, 0.0], 3).collect()] == [1, 2] and len(index.log.live()) == 1
    assert index.search([1.0, 0.0, 0.0], 3).collect() == []
