import random

import pyarrow as pa
import zstandard
from helpers import docs, empty, read, substring_dedup

from folioquery.llm import kit, queries
from folioquery.llm import substring_dedup as op


def collect(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in df.collect()}


def test_query(spark, sf):
    got = {r.doc_id: (r.n_words, r.n_removed) for r in queries.op1_substring_dedup(spark, sf).collect()}
    want = {k: v[:2] for k, v in substring_dedup([r[:2] for r in read(sf, "documents")]).items()}
    assert got == want


def test_brute_force_with_small_windows(spark):
    rng = random.Random(3)
    vocabulary = ["a", "b", "É", "long-word", "x."]
    rows = [(i, rng.choice([" ", "\n", " \t "]).join(rng.choices(vocabulary, k=rng.randint(0, 40)))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(200, "z " * 50)]
    df = docs(spark, rows).repartition(5)
    for width, inner in ((4, 2), (5, 5)):
        assert collect(op.remove_repeats(df, width, inner)) == substring_dedup(rows, width)
    assert collect(op.remove_repeats(df, 4, 2, flush_bytes=64, bucket_bytes=64)) == substring_dedup(rows, 4)


def test_edges(spark):
    assert op.remove_repeats(empty(spark)).collect() == []
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(1, None), (2, ""), (3, " \n "), (5, long), (4, long), (4, long), (None, long), (6, "short text")]
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, r.n_removed) for r in op.remove_repeats(docs(spark, rows)).collect())
    assert got == [((False, 1), 0, 0), ((False, 2), 0, 0), ((False, 3), 0, 0), ((False, 4), 30, 0), ((False, 4), 30, 0), ((False, 5), 30, 30), ((False, 6), 2, 0), ((True, 0), 30, 30)]


def test_spans_are_reported(spark):
    base = [f"w{i}" for i in range(25)]
    rows = [(1, " ".join(base)), (2, "x " + " ".join(base[:20]) + " y")]
    got = {r.doc_id: [(s.start, s.end) for s in r.removed] for r in op.remove_repeats(docs(spark, rows)).collect()}
    assert got == {1: [], 2: [(1, 21)]}


def test_hash_collisions_do_not_remove(monkeypatch):
    """With a hash that makes all windows equal, only windows with equal text repeat."""
    import numpy as np

    text = b"a b c d\na b c e\na b c d"
    record = np.zeros(3, op._RECORD)
    record["doc"], record["words"] = [1, 2, 3], 4
    block = zstandard.ZstdCompressor().compress((3).to_bytes(8, "little") + record.tobytes() + text)
    monkeypatch.setattr(kit.Spans, "of", lambda self, s, e: np.zeros(len(s), np.uint64))
    found = list(op.repeats_in_bucket([block], 4, 1 << 20))
    assert [(d, np.frombuffer(x, "<i4").tolist()) for d, _, x in found] == [(3, [0, 4])]


def test_a_frequent_phrase_fills_no_bucket(spark):
    """A phrase in ever new surroundings, whose run has the smallest hash of all: with it ranked last its windows spread over the buckets."""
    import numpy as np

    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    phrases = [" ".join(word() for _ in range(4)) for _ in range(3000)]
    first = min(phrases, key=lambda p: int(op.run_hashes(kit.Words(*kit.text_arrays(pa.array([p]))), 4)[0]))
    rows = [(i, " ".join([*(word() for _ in range(30)), first, *(word() for _ in range(30))])) for i in range(400)]
    rows += [(1000 + i, f"{' '.join(rows[i][1].split()[25:50])} end") for i in range(0, 400, 40)]
    df = docs(spark, rows)
    frequent = op.frequent_runs(df, 4)
    assert len(frequent) == 1
    words = kit.Words(*kit.text_arrays(pa.array([t for _, t in rows])))

    def largest(f):
        _, _, size, least = op.super_kmers(words, 20, 4, f)
        return np.unique(least, return_counts=True)[1].max()

    assert largest(None) >= 400 and largest(frequent) <= 20
    for limit in (128 << 20, 2000):
        assert collect(op.remove_repeats(df, bucket_bytes=limit)) == substring_dedup(rows)


def test_cut_out():
    import numpy as np

    body = b"abcdefghijklmnop"
    start, end = np.array([8, 1, 2, 13, 3]), np.array([10, 4, 6, 15, 5])
    text, at = op._cut_out(body, start, end)
    assert text == b"bcdef" + b"ij" + b"no"
    assert [text[a : a + e - s] for a, s, e in zip(at, start, end)] == [body[s:e] for s, e in zip(start, end)]


def test_super_kmers_cover_all_windows():
    words = kit.Words(*kit.text_arrays(pa.array([" ".join(f"w{i % 7}" for i in range(50)), "a b", " ".join(f"v{i}" for i in range(25))])))
    doc, first, size, _ = op.super_kmers(words, 20, 4)
    covered = [(d, f + k) for d, f, n in zip(doc, first, size) for k in range(n - 19)]
    assert covered == [(0, i) for i in range(31)] + [(2, 52 + i) for i in range(6)]
