import math
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from helpers import docs, empty, read, words
from pyspark.sql import functions as F

from folioquery.llm import kit, queries
from folioquery.llm import lm_scoring as op

END, START, NONE = ("end",), ("start",), ("none",)


class Reference:
    def __init__(self, texts, order=3):
        runs = [[*words(t, True), END] for t in texts]
        self.order = order
        self.c = Counter(w for r in runs for w in r)
        self.n, self.v = sum(self.c.values()), len(self.c)
        pairs = Counter(p for r in runs for p in zip([START, *r], r))
        self.t = Counter(p for r in runs for p in zip([START, *r], r, r[1:])) if order == 3 else Counter()
        if order == 3:  # different left neighbours, but occurrences where nothing precedes
            before = Counter((v, w) for _, v, w in self.t)
            pairs = Counter({p: k if p[0] == START else before[p] for p, k in pairs.items()})
        self.b = pairs
        self.follow = Counter(w for _, w in self.b)
        self.d = [self.discounts(x) for x in (self.follow, self.b, self.t)]
        self.rest = sum(self.d[0][min(x, 3)] for x in self.follow.values())
        self.ctx = defaultdict(lambda: [0, 0, 0, 0])
        for *v, _, k in ((*p, k) for x in (self.b, self.t) for p, k in x.items()):
            self.ctx[tuple(v)][0] += k
            self.ctx[tuple(v)][min(k, 3)] += 1

    @staticmethod
    def discounts(counts):
        n = [sum(v == k for v in counts.values()) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0
        return [0, *(min(k, max(0, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] else 0 for k in (1, 2, 3))]

    def p1(self, w):
        d, total = self.d[0], len(self.b)
        k = self.follow.get(w, 0)
        return (k - d[min(k, 3)]) / total + self.rest / total / (self.v + 1)

    def step(self, context, k, d, shorter):
        if context not in self.ctx:
            return shorter
        x = self.ctx[context]
        return (k - d[min(k, 3)]) / x[0] + sum(d[j] * x[j] for j in (1, 2, 3)) / x[0] * shorter

    def p(self, u, v, w):
        p = self.step((v,), self.b.get((v, w), 0), self.d[1], self.p1(w))
        return p if self.order == 2 else self.step((u, v), self.t.get((u, v, w), 0), self.d[2], p)

    def score(self, text):
        r = [*words(text, True), END]
        base = sum(math.log10((self.c.get(w, 0) + 1) / (self.n + self.v + 1)) for w in r)
        return len(r), sum(w in self.c for w in r), self.n, base, sum(math.log10(self.p(*x)) for x in zip([NONE, START, *r], [START, *r], r))


def check(got, rows, model):
    for r in got:
        want = model.score(rows[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
        assert r.base_score == pytest.approx(want[3], rel=1e-9) and r.score == pytest.approx(want[4], rel=1e-9)


def test_query(spark, sf):
    rows = {r[0]: r[1] for r in read(sf, "documents")}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in rows}
    got = queries.op6_lm_scoring(spark, sf).collect()
    assert {r.doc_id: r.held_out for r in got} == held
    check(got, rows, Reference([t for i, t in rows.items() if not held[i]]))


@pytest.mark.parametrize("order", [2, 3])
def test_edges(spark, order):
    rows = {1: None, 2: "", 3: "a b a b a", 4: "A É x", 5: "a b c d e f g a b", 6: "zz yy", 7: "x", 8: "a b a q b a b"}
    df = docs(spark, list(rows.items()))
    model = op.train(df, F.col("doc_id") < 6, order=order)
    got = op.score(df, model).collect()
    check(got, rows, Reference([t for i, t in rows.items() if i < 6], order))
    assert all(r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens)) for r in got)


@pytest.mark.parametrize("order", [2, 3])
def test_frequent_words_are_dealt_over_shards(spark, order):
    rows = {i: " ".join(f"the w{(i * 7 + k) % 50} of the" for k in range(40)) for i in range(300)}
    rows |= {1000 + i: "of the" for i in range(4000)} | {5000 + i: f"the x{i} the y{i % 9}" for i in range(900)}
    df = docs(spark, list(rows.items())).repartition(4)
    model = op.train(df, order=order, flush_tokens=500)
    assert len(model.heavy) >= 3 and model.heavy[0] == op.START and model.spread.max() >= 5
    check(op.score(df, model).collect(), rows, Reference(rows.values(), order))


def test_wide_ids_and_counts():
    """Ids and counts beyond 32 bits, packed in one word or not."""
    import numpy as np

    for top in (2**40, 2**20):
        keys = [np.array([top + 5, 3, top + 5, top // 2]), np.array([7, 7, 7, top]), np.array([1, 2, 1, 2**14])]
        counts = [2**32 + 9, 1, 4, 2**33]
        got, n = op._collapse(keys, np.array(counts))
        want = Counter()
        for row, k in zip(zip(*(x.tolist() for x in keys)), counts):
            want[row] += k
        assert list(zip(*(x.tolist() for x in got))) == sorted(want) and n.tolist() == [want[k] for k in sorted(want)]
        assert op._collapse(keys, None)[1].tolist() == [Counter(zip(*(x.tolist() for x in keys)))[k] for k in sorted(want)]
        back = op._open(op._squeeze(*got, n), 4)
        assert all((x == y).all() for x, y in zip(back, [*got, n], strict=True))


def test_sorting_by_values():
    import numpy as np

    rng = np.random.default_rng(5)
    near = kit.mix(np.arange(40, dtype=np.uint64))  # keys that differ in their low bits alone, many times each
    for keys, bits in ((rng.integers(0, 2**63, 3000, dtype=np.uint64), 64), (np.zeros(0, np.uint64), 64), (np.ones(1, np.uint64), 64), (rng.integers(0, 50, 3000).astype(np.uint64), 6), (np.concatenate([near, near ^ np.uint64(3), near ^ np.uint64(1)] * 30), 64)):
        keys = rng.permutation(keys)
        assert (keys[kit.order_of(keys, bits)] == np.sort(keys)).all()
        found, at = kit.distinct(keys, bits)
        assert (found == np.unique(keys)).all() and (found[at] == keys).all()


@pytest.mark.parametrize("n", [0, 1, 5, 3000])
def test_tables_mounted_and_paged(tmp_path, n, monkeypatch):
    import numpy as np

    keys = kit.mix(np.arange(2 * n, dtype=np.uint64))
    values = np.stack([np.arange(n) % 300, np.arange(n) % 7 + 2**33], 1)
    kit.put_file(f"file://{tmp_path}/t-0", op.pack_table(keys[::2], values))
    kit.put_file(f"file://{tmp_path}/words", np.sort(keys).tobytes())
    for mounted in (True, False):
        if not mounted:
            monkeypatch.setattr(kit, "local_path", lambda uri: None)
            monkeypatch.setattr(kit.Paged, "KEPT", 2)
        t = op.Table(f"file://{tmp_path}/t-0")
        hit, found = t.find(keys)
        assert hit.tolist() == [True, False] * n and (found == values).all()
        if n:
            words = kit.map_file(f"file://{tmp_path}/words", "<u8", 0, 2 * n)
            asked = np.concatenate([keys, keys + np.uint64(1), keys - np.uint64(1)])
            assert (kit.search_sorted(words, 2 * n, asked) == np.searchsorted(np.sort(keys), asked)).all()


def test_without_a_mount_a_worker_reads_only_pages(spark, tmp_path, monkeypatch):
    rows = {i: f"w{i} w{i + 1} w{i % 7} again" for i in range(200)}
    df = docs(spark, list(rows.items()))
    model = op.train(df)
    monkeypatch.setattr(kit, "local_path", lambda uri: None)
    data, bounds = kit.text_arrays(pa.array(list(rows.values())))
    got = op.Scorer(model).score(data, bounds)
    want = [Reference(rows.values()).score(t) for t in rows.values()]
    assert got[0].tolist() == [x[0] for x in want] and got[3].tolist() == pytest.approx([x[4] for x in want], rel=1e-9)


@pytest.mark.parametrize("order", [2, 3])
def test_distribution_sums_to_one(order):
    m = Reference(["a b a c", "b a", "c c a d", "b a c"], order)
    for u, v in ((NONE, START), (START, "a"), ("b", "a"), ("nope", "a"), ("b", "nope")):
        assert sum(m.p(u, v, w) for w in [*m.c, "unknown"]) == pytest.approx(1)


def test_empty(spark):
    model = op.train(empty(spark))
    assert op.score(empty(spark), model).collect() == []
    r = op.score(docs(spark, [(1, "a")]), model).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (2, 0, 0, 0.0, 0.0)
