import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import docs, empty, read

from folioquery.llm import packing as op
from folioquery.llm import queries

PATH = queries.tokenizer_path()


def naive(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        fits = [(left, i) for i, left in enumerate(bins) if left >= x]
        if fits:
            bins[min(fits)[1]] -= x
        else:
            bins.append(capacity - x)
    return len(bins)


@pytest.mark.parametrize("seed", range(15))
def test_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 50, 2048])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 300))]
    placed, bins = op.plan_bins(Counter(lengths), capacity)
    assert bins == naive(lengths, capacity)
    count, used = Counter(lengths), defaultdict(list)
    for i, (length, rank, first, per, offset) in enumerate(placed):
        same = i + 1 < len(placed) and placed[i + 1][0] == length
        for r in range(rank, placed[i + 1][1] if same else count[length]):
            used[first + (r - rank) // per].append((offset + (r - rank) % per * length, length))
    assert sum(map(len, used.values())) == len(lengths)
    for parts in used.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity


def test_segment_tree():
    t = op.SegmentTree(20)
    for i in (3, 9, 17):
        t.set(i, True)
    assert [t.first_from(i) for i in (0, 3, 4, 10, 18)] == [3, 3, 9, 17, -1]
    t.set(9, False)
    assert t.first_from(4) == 17


def expected(rows, capacity=2048):
    from tokenizers import Tokenizer

    t, out = Tokenizer.from_file(PATH), []
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            part = np.array(ids[k : k + capacity], "<u4")
            out.append((i, k // capacity, k, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=str)


def check(df, rows, capacity):
    got = df.collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == expected(rows, capacity)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    assert len(bins) == naive([r.length for r in got], capacity)


def test_query(spark, sf):
    check(queries.op7_packing(spark, sf), [r[:2] for r in read(sf, "documents")], 2048)


def test_edges(spark):
    odd = ["", None, "it's <|endoftext|> 'll", "Σς İstanbul ﬁ é", "日本語 text", "a\x85b\xa0c\x1cd", "x1²½ !!'s", "word " * 300, "ǅ ǆ", "\U0001f600 ok"]
    rows = [(i, t) for i, t in enumerate(odd)] + [(3, "twice"), (3, "twice"), (None, "null id")]
    check(op.pack(op.cut_documents(docs(spark, rows), PATH, 32), 32), rows, 32)
    assert op.pack(op.cut_documents(empty(spark), PATH)).collect() == []


def test_ids_and_small_cache(spark):
    pieces = op.WordPieces(PATH, cache=3)
    texts = ["one two three four five six", "seven eight nine ten one two"]
    want = [pieces.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in pieces.encode(texts)] == want
    row = op.cut_documents(docs(spark, [(1, texts[0])]), PATH, with_ids=True).first()
    assert np.frombuffer(row.ids, "<u4").tolist() == [*want[0], 0]
