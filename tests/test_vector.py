import math

import pytest
from pyspark.sql import functions as F

from folioquery.operators import hybrid, vector

ROWS = [(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, [2.0, 0.0])]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id long, vector array<double>")


def test_top_k(rows):
    got = [(r.id, round(r.score, 6)) for r in vector.top_k(rows, "id", "vector", [1.0, 0.0], 3).collect()]
    assert got == [(1, 1.0), (5, 1.0), (2, 0.6)]
    assert vector.top_k(rows.where("id > 9"), "id", "vector", [1.0, 0.0], 3).collect() == []


def test_both_ways_agree(rows):
    native = {r.id: r.s for r in rows.select("id", vector.cosine(F.col("vector"), [0.3, 0.7]).alias("s")).collect()}
    for r in vector.scores(rows, "id", "vector", [0.3, 0.7]).collect():
        assert r.score == pytest.approx(native[r.id], abs=1e-6)


def test_store(spark, tmp_path):
    store = vector.VectorStore(spark, str(tmp_path / "v"))
    df = spark.createDataFrame(ROWS[:3], "id long, vector array<double>")
    store.add(df, 1)
    store.add(spark.createDataFrame([(1, [0.0, 3.0])], "id long, vector array<double>"), 2)
    store.remove(spark.createDataFrame([(2,)], "id long"), 3)
    assert store.count() == 2 and store.has_id(1) and not store.has_id(2)
    assert [r.id for r in store.search([0.0, 1.0], 5).collect()] == [1, 3]


def test_packing():
    assert vector.pack_greedy([5, 5, 5, 20, 1], 10) == [[0, 1], [2], [3], [4]]
    assert vector.pack_greedy([1] * 5, 100, 2) == [[0, 1], [2, 3], [4]]
    batches = vector.contextual_batches([[20, 20, 5], [3]], budget=25, per_batch=40)
    assert batches == [[(0, [0])], [(0, [1, 2]), (1, [0])]]
    assert vector.merge_parts(batches, [[["a"]], [["b", "c"], ["d"]]], 2) == [["a", "b", "c"], ["d"]]


def test_embed_and_cache(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "bb"), (3, None)], "id long, text string")
    out = vector.embed(rows, lambda texts: [[float(len(t))] for t in texts])
    assert sorted((r.id, r.vector) for r in out.collect()) == [(1, [1.0]), (2, [2.0]), (3, [0.0])]
    hit, miss = vector.split_cached(rows.where("text IS NOT NULL"), out.where("id = 1").select(F.sha2("text", 256).alias("sha256"), "vector"))
    assert ([r.id for r in hit.collect()], [r.id for r in miss.collect()]) == ([1], [2])


def legs(spark, v, k):
    return spark.createDataFrame(v, "id long, score double"), spark.createDataFrame(k, "id long, rank double")


def test_fusion(spark):
    v, k = legs(spark, [(1, 0.9), (2, 0.5), (3, 0.1)], [(2, -4.0), (4, -2.0)])
    got = {r.id: round(r.score, 6) for r in hybrid.fuse(v, k, "id", 10, 0.5).collect()}
    assert got == {1: 0.5, 2: 0.75, 3: 0.0, 4: 0.0}
    assert [r.id for r in hybrid.fuse(v, k, "id", 10, 0.5).collect()] == [2, 1, 3, 4]
    only = hybrid.fuse(v, k.where("id < 0"), "id", 10, 0.2).collect()
    assert [(r.id, r.score) for r in only][0] == (1, 1.0)
    assert hybrid.fuse(v.where("id < 0"), k.where("id < 0"), "id", 10).count() == 0


def test_rerank(spark):
    df = spark.createDataFrame([(1, "red fish", 0.9), (2, "blue fish here", 0.5), (3, None, 0.7)], "id long, content string, score double")
    got = hybrid.rerank(df, "blue fish", "content", 2).collect()
    assert [(r.id, r.score, r.original_score) for r in got] == [(2, 1.0, 0.5), (1, 0.5, 0.9)]
    with pytest.raises(KeyError):
        hybrid.rerank(df, "x", "nope", 2)
    with pytest.raises(ValueError):
        hybrid.rerank(df, "x", "content", 1001)


def test_normalize(rows):
    got = {r.id: r.v for r in rows.select("id", vector.normalize(F.col("vector")).alias("v")).collect()}
    assert got[4] == [0.0, 0.0] and math.isclose(got[5][0], 1.0)


def test_broken_vectors(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, None), (6, [0.0, 0.0]), (7, [1.0])], "id long, vector array<float>")
    assert [r.id for r in vector.top_k(rows, "id", "vector", [1.0, 1.0], 9).collect()] == [1, 6]
    shown = {r.id: r.c for r in rows.select("id", vector.cosine(F.col("vector"), [1.0, 1.0]).alias("c")).collect()}
    assert [i for i, c in shown.items() if c is not None] == [1, 6]
    assert [r.id for r in rows.where(vector.normalize(F.col("vector")).isNull()).collect()] == [2, 3, 4, 5]
    store = vector.VectorStore(spark, f"file://{tmp_path}/v")
    for i in (2, 3, 4, 5):
        with pytest.raises(ValueError):
            store.add(rows.where(f"id = {i}"), 1)
    with pytest.raises(ValueError):
        vector.top_k(rows, "id", "vector", [nan, 1.0], 1)


def test_a_tombstone_wins_a_tie(spark):
    for order in (1, -1):
        rows = spark.createDataFrame([(1, 5, [1.0]), (1, 5, None), (2, 5, [1.0]), (2, 5, [2.0])][::order], "id long, version long, vector array<double>")
        assert [(r.id, r.vector) for r in vector.latest(rows).collect()] == [(2, [2.0])]


def test_embedding_after_a_write(spark):
    from folioquery.operators import embedding

    before = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "gone")], "id long, text string")
    after = spark.createDataFrame([(1, "a"), (2, "bb"), (3, " "), (5, "new"), (6, None), (7, "new")], "id long, text string")
    queue = embedding.changed_texts(before, after, "id", "text")
    assert sorted((r.id, r.text) for r in queue.collect()) == [(2, "bb"), (5, "new"), (7, "new")]
    assert sorted(r.id for r in embedding.lost_texts(before, after, "id", "text").collect()) == [3, 4]

    def short(texts):
        return [[float(len(t))] for t in texts][: 1 if "few" in texts else None]

    rows = spark.createDataFrame([(1, "one two"), (2, "few"), (3, "x"), (4, "three more words")], "id long, text string").coalesce(1)
    got = {r.id: (r.vector, r.error) for r in embedding.embed_rows(rows, "id", "text", short, budget=2).collect()}
    assert got[1] == ([7.0], None) and got[4] == ([16.0], None)  # above the budget: alone
    assert got[2][0] is None and got[3][0] is None and "1 vectors for 2 texts" in got[2][1]
    cache = spark.createDataFrame([("bb", [9.0])], "t string, vector array<double>").select(F.sha2("t", 256).alias("sha256"), "vector")
    asked = []
    done, failed = embedding.flush(queue, "id", "text", lambda texts: [[float(len(t))] for t in texts], cache, "t", "text")
    assert sorted((r.id, r.vector) for r in done.collect()) == [(2, [9.0]), (5, [3.0]), (7, [3.0])] and failed.count() == 0 and not asked


def test_contextual_chunks_are_cut_and_put_together(spark):
    from folioquery.operators import embedding

    rows = spark.createDataFrame([(d, i, f"w{d} " * (i + 1)) for d in (1, 2) for i in range(6)], "d long, i long, t string").repartition(3)
    seen = lambda documents: [[(float(len(c)), float(t.split()[0][1:]), float(len(t.split()))) for t in c] for c in documents]
    got = {(r.d, r.i): r.vector for r in embedding.embed_chunks(rows, "d", "i", "t", seen, context=8, batch=12).collect()}
    assert all(got[d, i][1:] == [float(d), i + 1.0] for d in (1, 2) for i in range(6))
    assert got[1, 0][0] == 3.0 and got[1, 5][0] == 1.0  # 1 + 2 + 3 words, then 4, 5 and 6 alone
    bad = embedding.embed_chunks(rows, "d", "i", "t", lambda documents: [[]], context=8, batch=12).collect()
    assert len(bad) == 12 and all(r.vector is None and r.error for r in bad)


def test_each_text_is_sent_once(spark, tmp_path):
    """An embedder that fails its first call: the row is in the outbox, and nobody asks again."""
    from folioquery.operators import embedding

    log = str(tmp_path / "calls")

    def first_fails(texts):
        with open(log, "a+") as f:
            f.seek(0)
            asked = len(f.read().split())
            f.write(f"{len(texts)}\n")
        if not asked:
            raise TimeoutError("later")
        return [[1.0] for _ in texts]

    queue = spark.createDataFrame([(1, "a")], "id long, text string").coalesce(1)
    cache = spark.createDataFrame([], "sha256 string, vector array<double>")
    done, failed = embedding.flush(queue, "id", "text", first_fails, cache, "t", "text")
    for _ in range(2):
        assert done.count() == 0 and [tuple(r) for r in failed.collect()] == [("t", "text", 1, "a")]
    assert open(log).read().split() == ["1"]


def test_only_the_document_that_fails_gets_the_error(spark):
    from folioquery.operators import embedding

    rows = spark.createDataFrame([(d, i, f"w{d} x{i}") for d in range(6) for i in range(3)], "d long, i long, t string").coalesce(1)

    def picky(documents):
        if any("w3" in t for c in documents for t in c):
            raise ValueError("refused")
        return [[(float(len(t)),) for t in c] for c in documents]

    got = embedding.embed_chunks(rows, "d", "i", "t", picky).collect()
    assert {r.d for r in got if r.error} == {3} and all((r.vector is None) == (r.d == 3) for r in got) and len(got) == 18


def test_a_store_is_for_one_dimension_and_model(spark, tmp_path):
    at = f"file://{tmp_path}/v"
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "id long, vector array<double>")
    store = vector.VectorStore(spark, at, "model-a")
    store.add(rows.limit(0), 1)
    store.add(rows, 1)
    three = spark.createDataFrame([(3, [1.0, 0.0, 0.0])], "id long, vector array<double>")
    for wrong in (three, rows.unionByName(three)):
        with pytest.raises(vector.StoreMismatch):
            store.add(wrong, 2)
    with pytest.raises(vector.StoreMismatch):
        store.search([1.0, 0.0, 0.0], 1)
    with pytest.raises(vector.StoreMismatch):
        vector.VectorStore(spark, at, "model-b")
    again = vector.VectorStore(spark, at)
    assert [r.id for r in again.search([0.0, 1.0], 1).collect()] == [2] and again.count() == 2


def test_scores_meet_the_filtered_rows_not_vectors(spark):
    from folioquery.plans.fixtures import database

    q = database(spark, "/root/testdata/sf0.001").table("docs").eq("lang", "en").vector_search([1.0] * 64, "embedding", 15).select("id").frame()
    plan = q._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("LeftSemi") < plan.index("MapInArrow")
