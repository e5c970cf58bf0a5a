import random

import numpy as np
import pyarrow as pa
from helpers import docs, empty, lcs, read, words

from folioquery.llm import decontamination as op
from folioquery.llm import kit, queries


def test_query_finds_every_copy(spark, sf):
    items = {r[0]: r[1] for r in read(sf, "benchmark")}
    texts = {r[0]: " ".join(words(r[1])) for r in read(sf, "documents")}
    copies = {(d, i) for i, t in items.items() for d, x in texts.items() if " ".join(words(t)) in x}
    got = {(r.doc_id, r.item_id) for r in queries.op9_decontamination(spark, sf).collect()}
    assert copies <= got
    for d, i in got:
        assert lcs(words(items[i], True), words(texts[d], True)) >= 0.6 * len(words(items[i])) - 3


def planted(rng, n_docs=150, n_items=25):
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 7))) for _ in range(3000)]
    common = vocabulary[:40]
    text = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(n)]
    items = [text(rng.randint(15, 110)) for _ in range(n_items)]
    rows, truth = [], set()
    for d in range(n_docs):
        body = text(rng.randint(20, 300))
        if d % 3 == 0:
            k = rng.randrange(n_items)
            part = list(items[k])
            if d % 2:  # a paraphrase: a fifth of the words replaced
                for i in range(0, len(part) - 8, 5):
                    part[i] = rng.choice(vocabulary)
            at = rng.randrange(len(body))
            body[at:at] = part
            truth.add((d, k))
        rows.append((d, " ".join(body)))
    return rows, [(k, " ".join(w)) for k, w in enumerate(items)], truth


def test_paraphrases_against_brute_force(spark):
    rows, items, truth = planted(random.Random(11))
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = op.find_leaks(docs(spark, rows), bench, block_items=10)
    got = {(r.doc_id, x.item_id) for r in out.collect() for x in r.leaks}
    brute = set()
    for d, t in rows:
        w = words(t, True)
        for k, x in items:
            y = words(x, True)
            windows = (w[a : a + len(y) + 16] for a in range(0, max(1, len(w) - len(y)), 8))
            if any(lcs(y, z) >= 0.6 * len(y) for z in windows):
                brute.add((d, k))
    assert truth <= brute
    assert len(got & brute) >= 0.95 * len(brute) and len(got - brute) <= 1


def test_items_held_by_a_third_of_the_documents(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 7))) for _ in range(4000)]
    items = [(k, " ".join(rng.sample(vocabulary, n))) for k, n in enumerate((15, 18, 40, 80))]
    items += [(k, " ".join(f"rare{k}x{i}" for i in range(30))) for k in range(4, 40)]  # no document holds these
    rows, truth = [], set()
    for d in range(240):
        body = rng.choices(vocabulary, k=rng.randint(100, 250))
        k = rng.randrange(3) if d < 80 else 3
        if d < 160 and d % 2:
            at = rng.randrange(len(body))
            body[at:at] = items[k][1].split()
        elif d % 3 == 0:  # the short item is everywhere
            at, k = rng.randrange(len(body)), 0
            body[at:at] = items[0][1].split()
        else:
            k = None
        if k is not None:
            truth.add((d, k))
        rows.append((d, " ".join(body)))
    assert truth == {(d, k) for d, t in rows for k, x in items if f" {x} " in f" {t} "}
    assert sum(k == 0 for _, k in truth) > 40 and sum(k == 3 for _, k in truth) > 30
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, x.item_id) for r in op.find_leaks(docs(spark, rows), bench).collect() for x in r.leaks}
    assert got == truth


def test_many_subsequences_at_once():
    rng = random.Random(3)
    words = [np.array([rng.randrange(1, 9) for _ in range(rng.randint(1, 48))], np.uint64) for _ in range(30)]
    terms = op.Terms(np.concatenate(words))
    counted = op.Counted.of(words, terms, np.arange(len(terms)), 0.6)
    region = np.array([rng.randrange(1, 12) for _ in range(90)], np.uint64)
    lo = np.array([rng.randrange(40) for _ in words])
    hi = lo + np.array([rng.randrange(50) for _ in words])
    got = counted.common(np.arange(len(words)), lo, hi, terms.find(region))
    assert got.tolist() == [op.common_subsequence(w.tolist(), region[a:b].tolist()) for w, a, b in zip(words, lo, hi, strict=True)]


def test_answer_must_be_there(spark):
    rng = random.Random(2)
    w = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(60)]
    bench = spark.createDataFrame([(1, " ".join(w[:30]), " ".join(w[40:44]))], "item_id long, text string, answer string")
    rows = [(1, " ".join(w[:30])), (2, " ".join([*w[:30], *w[40:44]]))]
    got = {r.doc_id: len(r.leaks) for r in op.find_leaks(docs(spark, rows), bench).collect()}
    assert got == {1: 0, 2: 1}


def test_a_copy_without_the_answer_hides_no_other(spark):
    """The longest copy lacks the answer; a shorter one further on, or before it, has it."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    items, rows, truth = [], [], {}
    for k, n in enumerate((30, 40, 90)):
        w, answer = [word() for _ in range(n)], [word() for _ in range(4)]
        items.append((k, " ".join(w), " ".join(answer)))
        gap = [[word() for _ in range(m)] for m in (50, 170, 333)]
        short = [x for i, x in enumerate(w) if i % 5]
        for j, parts in enumerate(((w, gap[1], short, answer), (short, answer, gap[2], w), (w, gap[0], short), (w, gap[1], answer), (short, answer), (gap[0], w, answer))):
            rows.append((10 * k + j, " ".join(x for p in (gap[0], *parts, gap[2]) for x in p)))
            truth[10 * k + j] = [k] if j not in (2, 3) else []
    bench = spark.createDataFrame(items, "item_id long, text string, answer string")
    got = {r.doc_id: [x.item_id for x in r.leaks] for r in op.find_leaks(docs(spark, rows), bench).collect()}
    assert got == truth


def test_edges(spark):
    bench = spark.createDataFrame([(1, "only words here"), (2, None), (3, ""), (1, "only words here")], "item_id long, text string")
    rows = [(1, None), (2, ""), (None, "Only words, here!"), (4, "only words here"), (4, "only words here")]
    out = op.find_leaks(docs(spark, rows), bench)
    assert out.columns[-1] == "leaks"
    got = sorted((r.doc_id or -1, len(r.leaks)) for r in out.collect())
    assert got == [(-1, 2), (1, 0), (2, 0), (4, 2), (4, 2)]
    assert op.find_leaks(empty(spark), bench).collect() == []
    assert all(not r.leaks for r in op.find_leaks(docs(spark, rows), bench.where("false")).collect())


def test_subsequence_and_terms():
    rng = random.Random(1)
    for _ in range(50):
        a, b = [rng.randrange(5) for _ in range(rng.randint(0, 20))], [rng.randrange(5) for _ in range(rng.randint(0, 20))]
        assert op.common_subsequence(a, b) == lcs(a, b)
    h = kit.mix(np.arange(5000, dtype=np.uint64))
    t = op.Terms(h[::2])
    found = t.find(h)
    assert (found[::2] >= 0).all() and (found[1::2] == -1).all() and (t.hashes[found[::2]] == h[::2]).all()
    one = kit.Words(*kit.text_arrays(pa.array(["Word, (word) WORD..."])), lower=True)
    assert len(set(op.term_hashes(one).tolist())) == 1


def test_svd_spans_the_rows(spark):
    rng = np.random.default_rng(0)
    base, rows = rng.standard_normal((3, 20)).astype("<f4"), []
    for _ in range(40):
        v = (rng.standard_normal(3) @ base).astype("<f4")
        rows.append((bytearray(np.arange(20, dtype="<i4").tobytes()), bytearray(v.tobytes())))
    basis = op.randomised_svd(spark.createDataFrame(rows, "ids binary, vals binary"), 20, 3)
    left = base - (base @ basis) @ basis.T
    assert np.abs(left).max() < 1e-3


def test_stripes_find_what_whole_documents_hold(spark):
    rng = random.Random(9)
    rows, items, _ = planted(rng, 30, 12)
    long = " ".join(t for _, t in rows) + " " + "y" * 5000 + " " + " ".join(t for _, t in rows[::-1])
    index = op.fit(docs(spark, rows), [(k, t, None) for k, t in items])
    data, bounds = kit.text_arrays(pa.array([long]))
    want = op.search(index, data, bounds, 0.35, 0.6, 0.5)[0]
    assert len(want) >= 4
    for stripe in (1500, 4000, 20_000):
        assert op.search(index, data, bounds, 0.35, 0.6, 0.5, stripe)[0] == want


def test_memory_does_not_follow_the_text(spark):
    """2,000 passages beside a text of 20 MB."""
    import tracemalloc

    rng = np.random.default_rng(2)
    word = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 60_000, n))
    items = [(k, word(40), None) for k in range(2000)]
    index = op.fit(docs(spark, [(1, items[0][1])]), items, rank=16, least_energy=0)
    text = word(3_000_000) + " " + items[7][1] + " " + word(100_000)
    data, bounds = kit.text_arrays(pa.array([text]))
    assert len(data) > 19e6
    tracemalloc.start()
    found = op.search(index, data, bounds, 0.35, 0.6, 0.5)[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 7 in {x["item_id"] for x in found} and peak < 600e6
