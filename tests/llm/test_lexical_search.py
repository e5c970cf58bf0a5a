"""Lexical search against a brute-force version."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from helpers import docs
from hypothesis import given, settings
from hypothesis import strategies as st

from folioquery.llm import lexical_search as ls

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UP))


def brute(rows, items, k=10):
    held = [(i, terms(t)) for i, t in rows]
    held = [(i, t) for i, t in held if t]
    n, total = len(held), sum(len(t) for _, t in held)
    df = Counter(w for _, t in held for w in set(t))
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in asked.items():
        found = []
        for i, t in held:
            tf, m = Counter(t), 10 + 90 * len(t) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 8 * m)) for w in words if tf[w])
            if score > 0:
                found.append((-score, i is None, i or 0))
        found.sort()
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


def asked(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "item_id long, text string, rank int, term long, score long")


def ran(spark, rows, items, k=10):
    return sorted((tuple(r) for r in ls.search(docs(spark, rows), asked(spark, items), k).collect()), key=repr)


def test_edges(spark):
    rows = [(3, "Alpha beta, beta GAMMA"), (1, "alpha beta"), (2, "alpha beta"), (2, "alpha beta"), (None, "alpha beta"), (None, None), (4, ""), (5, "!?"), (6, "été ÉTÉ e-t-e 3.5"), (7, "delta " * 50)]
    items = [(0, "ALPHA alpha beta"), (0, "gamma"), (1, None), (2, "unknown"), (None, "delta"), (3, "ÉTÉ 3 5"), (4, "...")]
    assert ran(spark, rows, items) == brute(rows, items)
    assert ran(spark, rows, items, 2) == brute(rows, items, 2)


def test_empty_tables(spark):
    assert ran(spark, [], [(1, "a")]) == [] and ran(spark, [(1, "a b")], []) == [] and ran(spark, [(1, None)], [(1, "a")]) == []


def test_long_text_in_stripes(spark):
    long = " ".join(f"w{i % 997}" for i in range(200_000)) + " needle " + "x" * 900_000
    rows = [(1, long), (2, "needle w5"), *[(i, f"w{i}") for i in range(3, 30)]]
    assert ran(spark, rows, [(0, "needle w5 w12"), (1, "x" * 900_000)]) == brute(rows, [(0, "needle w5 w12"), (1, "x" * 900_000)])


def test_many_blocks_and_full_heaps(spark, monkeypatch):
    rows = [(i, " ".join(f"t{(i * j) % 41}" for j in range(1, 9))) for i in range(300)]
    items = [(i, f"t{i} t{(3 * i) % 41} t{(7 * i) % 41}") for i in range(40)]
    monkeypatch.setattr(ls, "BLOCK_ROWS", 25)
    assert ran(spark, rows, items) == brute(rows, items)


def test_given_tables(spark, sf):
    import duckdb

    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    assert ran(spark, rows, items) == brute(rows, items)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**63), max_size=200), st.integers(1, 2**63))
def test_radix_order(keys, most):
    keys = np.array([k % (most + 1) for k in keys], np.uint64)
    assert (keys[ls.radix_order(keys, most)] == np.sort(keys)).all()


@pytest.mark.parametrize("n", [7, 10**9])
def test_wide_lengths(n):
    got = ls.lengths(np.array([1, 10**9]), n, 10**12)
    assert got.tolist() == [10 + 90 * n // 10**12, 10 + 90 * 10**9 * n // 10**12]
