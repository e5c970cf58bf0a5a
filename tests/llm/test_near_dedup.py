import random

import numpy as np
import pytest
from helpers import docs, empty, near_components, read

from folioquery.llm import near_dedup as op
from folioquery.llm import queries
from folioquery.llm.components import connected_components


def collect(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def corpus(seed, families=12, copies=14):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    rows = []
    for f in range(families):
        base = [word() for _ in range(rng.randint(20, 120))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // 30)):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_query(spark, sf):
    got = collect(queries.op5_near_dedup(spark, sf))
    assert got == near_components([r[:2] for r in read(sf, "documents")], 3, 85)


@pytest.mark.parametrize(("seed", "k", "share"), [(1, 3, 85), (2, 5, 80)])
def test_brute_force(spark, seed, k, share):
    rows = corpus(seed)
    assert collect(op.near_duplicates(docs(spark, rows).repartition(3), k, share)) == near_components(rows, k, share)


def test_links_between_members_that_are_not_the_smallest(spark):
    """A chain: neighbours are linked, the ends are not."""
    rng = random.Random(9)
    w = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(100)]
    rows = []
    for i in range(8):
        rows.append((50 - i, " ".join(w)))
        for _ in range(2):
            w[rng.randrange(100)] = "".join(rng.choices("abcdefghij", k=6))
    assert collect(op.near_duplicates(docs(spark, rows), 3, 85)) == near_components(rows, 3, 85)


def test_edges(spark):
    assert op.near_duplicates(empty(spark)).collect() == []
    rows = [(1, None), (2, ""), (3, "A b"), (4, "a B"), (5, "a b c d"), (6, "a b c d"), (6, "a b c d"), (None, "a b c d")]
    got = sorted(((r.doc_id or -1), r.n_shingles, r.component_id, r.kept) for r in op.near_duplicates(docs(spark, rows), 3, 85).collect())
    assert got == [(-1, 2, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (5, 2, 5, True), (6, 2, 5, False), (6, 2, 5, False)]


def test_rows_that_share_an_id_are_one_node(spark):
    rows = [(1, "a b c d e"), (2, "p q r s t"), (2, "a b c d e"), (3, "p q r s t")]
    got = sorted((r.doc_id, r.component_id) for r in op.near_duplicates(docs(spark, rows), 3, 85).collect())
    assert got == [(1, 1), (2, 1), (2, 1), (3, 1)]


def test_pigeonhole():
    rng = np.random.default_rng(4)
    sig = rng.integers(0, 65536, (300, op.POSITIONS)).astype("<u2")
    other = sig.copy()
    for row in other:
        at = rng.choice(op.POSITIONS, op.GUARANTEED, replace=False)
        row[at] ^= 1
    assert (op.index_values(sig) == op.index_values(other)).any(1).all()


@pytest.mark.parametrize("few", [0, 1000])
def test_components(spark, few):
    edges = [(5, 4), (4, 3), (3, 5), (10, 11), (11, 12), (12, 13), (13, 14), (20, 20), (None, 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), few).collect()}
    assert got == {4: 3, 5: 3, 11: 10, 12: 10, 13: 10, 14: 10}
    chain = spark.range(100).selectExpr("id AS a", "id + 1 AS b")
    assert {r.component for r in connected_components(chain, few).collect()} == {0}
    assert connected_components(chain.where("false"), few).collect() == []


def test_both_ways_on_random_graphs(spark):
    rng = np.random.default_rng(6)
    for n in (30, 200):
        e = spark.createDataFrame([tuple(map(int, x)) for x in rng.integers(0, n, (n * 2 // 3, 2))], "a long, b long")
        both = [sorted(map(tuple, connected_components(e, few).collect())) for few in (0, 1000)]
        assert both[0] == both[1]
