"""Hard negatives against a brute-force version."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioquery.llm import hard_negatives as hn

INF = float("inf")


def brute(rows, every=100, positives=5, negatives=10):
    fit = {(i, x, tuple(int(np.floor(256 * float(np.float32(c)))) for c in v)) for i, x, v in rows if i is not None and x is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)}
    if fit:
        sizes = [len(v) for _, _, v in fit]
        dims = min(set(sizes), key=lambda d: (-sizes.count(d), d))
        fit = {r for r in fit if len(r[2]) == dims}
    out = []
    for a in fit:
        if a[0] % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2], strict=True)), b[0], b[1]) for b in fit if b != a)
        for ps, p, _ in [r for r in scored if r[2] == a[1]][:positives]:
            found = [r for r in scored if r[2] != a[1] and -30 * ps <= -100 * r[0] <= -90 * ps][:negatives]
            out += [(a[0], p, k, n, -ps, -s) for k, (s, n, _) in enumerate(found, 1)]
    return sorted(out)


def ran(spark, rows, every=100):
    wide = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, label int, embedding array<float>, pivot int, distance int, v int")
    return sorted(tuple(r) for r in hn.mine(wide, F.col("label"), F.col("vec_id") % every == 0).collect())


def test_edges(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 7))
    rows = [(i, int(i % 4), (centre[i % 6] + 0.3 * rng.normal(size=7)).tolist()) for i in range(400)]
    rows += [rows[0], rows[0], (0, 1, rows[5][2]), (100, 0, rows[9][2]), (100, 0, rows[10][2])]  # repeated rows and ids
    rows += [(None, 1, rows[0][2]), (500, None, rows[0][2]), (600, 1, None), (700, 1, [None] + [1.0] * 6), (800, 1, [INF] + [1.0] * 6), (900, 1, [float("nan")] * 7), (1000, 1, [1.0] * 3), (1100, 1, [])]
    rows += [(i, 0, [0.0] * 7) for i in range(1200, 1230)] + [(i, 1, [0.0] * 7) for i in range(1230, 1250)]  # ties at zero
    assert ran(spark, rows) == brute(rows)


def test_copies_of_one_vector(spark):
    rng = np.random.default_rng(6)
    rows = [(i, int(rng.integers(3)), (np.ones(5) + (0 if i % 3 else rng.normal(size=5))).tolist()) for i in range(600)]
    assert ran(spark, rows, 50) == brute(rows, 50)


def test_small_and_empty(spark):
    for rows in ([], [(0, 1, [1.0])], [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.5])], [(0, 1, []), (1, 1, [])], [(100, 1, [-1.0, 2.0]), (1, 1, [1.0, -2.0]), (2, 0, [1.0, 1.0])]):
        assert ran(spark, rows) == brute(rows)


def test_wide_components(spark):
    """Scores beyond 2**53 stay exact."""
    rng = np.random.default_rng(7)
    rows = [(i, i % 3, (rng.uniform(0.3, 1) * rng.uniform(2.5e5, 2.9e5, 4)).tolist()) for i in range(120)]
    got = ran(spark, rows)
    assert got == brute(rows) and max(r[4] for r in got) > 2**53


def test_given_table(spark, sf):
    import duckdb

    rows = duckdb.sql(f"SELECT vec_id, label, embedding FROM '{sf}/embeddings.parquet'").fetchall()
    assert ran(spark, rows) == brute(rows)


def test_search_leaves_blocks_out(spark):
    """On clustered vectors a certified search scores a part of all rows."""
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(20, 8))
    centre /= np.linalg.norm(centre, axis=1)[:, None]
    v = np.floor(256 * (centre[rng.integers(0, 20, 20_000)] + 0.01 * rng.normal(size=(20_000, 8)))).astype(int)
    table = spark.createDataFrame([(i, i % 2, r) for i, r in enumerate(v.tolist())], "vec_id long, label long, v array<long>")
    index, _ = hn.build(table, 11)
    q = v[:50].astype("<i4")
    wide = np.full((50, 1), 1 << 61)
    best, scored = hn.search(index, q, np.arange(50) % 2, True, -wide, wide, 6)
    scores = q.astype(int) @ v.T
    for j in range(50):
        want = sorted((-scores[j, i], i) for i in range(j % 2, 20_000, 2))[:6]
        at = best.search == j
        assert sorted(zip((-best.score[at]).tolist(), best.id[at].tolist(), strict=True)) == want
    assert scored < 0.3 * 50 * 20_000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-3, 3), st.integers(0, 9)), max_size=60), st.integers(1, 4))
def test_best(rows, k):
    best = hn.Best(4, k)
    for s, score, i in rows:
        best.offer(*(np.array([x]) for x in (s, score, i, 0)))
        if i % 3 == 0:
            best.sift()
    best.sift()
    want = [(s, score, i) for s in range(4) for score, i in sorted(((a, b) for x, a, b in rows if x == s), key=lambda r: (-r[0], r[1]))[:k]]
    assert list(zip(best.search.tolist(), best.score.tolist(), best.id.tolist(), strict=True)) == want


@pytest.mark.parametrize("n", [1, 3, 500])
def test_cluster(n):
    rng = np.random.default_rng(n)
    assert hn.cluster(rng.normal(size=(n, 4)), 16).shape == (min(n, 16), 4)
