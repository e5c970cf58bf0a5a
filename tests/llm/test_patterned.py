"""Texts of a regular pattern, whose polynomial hashes modulo 2**64 collide, and very long texts."""

import math
from collections import Counter

import numpy as np
import pytest
from helpers import docs, near_components, sha, words
from helpers import substring_dedup as brute_substrings

from folioquery.llm import decontamination, kit, line_dedup, lm_scoring, near_dedup, packing, queries, substring_dedup


def thue_morse(n, a="a", b="b"):
    return [b if bin(i).count("1") % 2 else a for i in range(n)]


@pytest.fixture(params=[1024, 4096])
def pair(request):
    """Two different strings of the same length, one the other's complement."""
    n = request.param
    return "".join(thue_morse(n)), "".join(thue_morse(n, "b", "a"))


def test_strings_and_their_equality(pair):
    data = np.frombuffer("".join(pair).encode(), np.uint8)
    n = len(pair[0])
    start, end = np.array([0, n]), np.array([n, 2 * n])
    for seed in (kit._BASE, kit._BASE2):
        assert len(set(kit.string_hashes(data, start, end, seed).tolist())) == 2
    sizes = np.arange(200)
    assert len(set(kit.string_hashes(data, np.zeros(200, np.int64), sizes).tolist())) == 200
    assert kit.equal_strings(data, np.array([0, 5]), data, np.array([0, 5]), np.array([n, 3]))
    assert not kit.equal_strings(data, np.array([0]), data, np.array([n]), np.array([n]))
    other = data.copy()
    other[n - 1] ^= 1
    assert not kit.equal_strings(data, np.array([0]), other, np.array([0]), np.array([n]))
    assert kit.equal_strings(data, np.array([0]), other, np.array([0]), np.array([n - 1]))


def test_substring_dedup(spark, pair):
    x, y = pair
    runs = [" ".join(thue_morse(len(x), *p)) for p in (("u", "v"), ("v", "u"))]
    rows = [(1, " ".join([x] * 20)), (2, " ".join([y] * 20)), (3, " ".join([x] * 19 + [y])), (4, " ".join([x] * 25)), (5, runs[0]), (6, runs[1]), (7, runs[0] + " end")]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(docs(spark, rows)).collect()}
    assert got == brute_substrings(rows)




@pytest.mark.parametrize("limit", [1 << 20, 33])
def test_line_dedup(spark, pair, limit):
    rows = [(i, pair[i > 2]) for i in range(5)]
    out = line_dedup.drop_repeated_lines(docs(spark, rows).select("doc_id", "text"), shard_bytes=limit)
    assert {r.doc_id: r.n_dropped for r in out.collect()} == dict.fromkeys(range(5), 0)


def test_near_dedup(spark, pair):
    x, y = pair
    tail = [f"w{i}" for i in range(10)]
    rows = [(1, x), (2, y), (3, x.upper()), (4, " ".join([x, *tail])), (5, " ".join([y, *tail])), (6, " ".join(tail * 3 + [x])), (7, " ".join(tail * 3 + [y]))]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs(spark, rows), 3, 85).collect()}
    assert got == near_components(rows, 3, 85)


def test_lm_scoring(spark, pair):
    x, y = pair
    rows = [(1, f"{x} a"), (2, f"{y} b {y}"), (3, y), (4, x[:-1])]
    df = docs(spark, rows)
    got = {r.doc_id: r for r in lm_scoring.score(df, lm_scoring.train(df)).collect()}
    count = Counter(w for _, t in rows for w in [*words(t), "</>"])
    n, v = sum(count.values()), len(count)
    for i, t in rows:
        toks = [*words(t), "</>"]
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(toks), len(toks), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in toks), rel=1e-9)


def test_packing(pair):
    x, y = pair
    pieces = packing.WordPieces(queries.tokenizer_path())
    texts = [x, y, f"{y} {x}", x[:-1], f"{x}. {y}! ab"]
    want = [pieces.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [z.tolist() for z in pieces.encode(texts)] == want
    assert [z.tolist() for z in pieces.encode(texts[1:2])] == want[1:2]


def test_packing_looks_at_the_text_where_hashes_collide(monkeypatch):
    """Where a hash takes two pre-tokens for one, the ids are still those of the text."""
    pieces = packing.WordPieces(queries.tokenizer_path())
    texts = ["something other", "different", "something", "shorter one"]
    want = [pieces.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(kit, "string_hashes", lambda data, start, end, seed=0: (end > start).astype(np.uint64))
    assert [z.tolist() for z in pieces.encode(texts)] == want
    assert [pieces.encode([t])[0].tolist() for t in texts] == want


def test_decontamination(spark, pair):
    x, y = pair
    filler = [f"f{i}" for i in range(60)]
    item = [f"q{i}" for i in range(12)]
    bench = spark.createDataFrame([(1, " ".join([*item, *[x] * 12]))], "item_id long, text string")
    rows = [(1, " ".join([*filler, *item, *[x] * 12, *filler])), (2, " ".join([*filler, *item, *[y] * 12, *filler])), (3, " ".join(filler))]
    got = {r.doc_id: len(r.leaks) for r in decontamination.find_leaks(docs(spark, rows), bench).collect()}
    assert got == {1: 1, 2: 0, 3: 0}


def test_very_long_texts(spark):
    """A text of 3 MB of its own, and its copy with an end of its own."""
    rng = np.random.default_rng(7)
    body = [f"w{i}" for i in rng.integers(0, 400_000, 380_000)]
    line = "\n".join(" ".join(body[k : k + 200]) for k in range(0, len(body), 200))
    rows = [(1, line), (2, line + "\nand more\n" + "z" * 300_000), (3, "short")]
    df = docs(spark, rows)
    got = {r.doc_id: (r.n_words, r.n_removed, sha(r.kept_text)) for r in substring_dedup.remove_repeats(df).collect()}
    assert got == {k: (*v[:2], sha(v[2])) for k, v in brute_substrings(rows).items()}
    assert [r.n_dropped for r in line_dedup.drop_repeated_lines(df.select("doc_id", "text"), min_docs=2).orderBy("doc_id").collect()] == [1900, 0, 0]
    near = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()}
    assert near == {1: 1, 2: 1, 3: 3}
    scored = {r.doc_id: r.n_tokens for r in lm_scoring.score(df, lm_scoring.train(df)).collect()}
    assert scored == {1: 380_001, 2: 380_004, 3: 2}
    pieces = packing.pack(packing.cut_documents(df.where("doc_id = 1"), queries.tokenizer_path()))
    ids = packing.WordPieces(queries.tokenizer_path()).tokenizer.encode(line, add_special_tokens=False).ids
    assert pieces.agg({"length": "sum"}).first()[0] == len(ids) + 1
    bench = spark.createDataFrame([(1, " ".join(body[1000:1040])), (2, " ".join(f"v{i}" for i in range(40)))], "item_id long, text string")
    assert {r.doc_id: [x.item_id for x in r.leaks] for r in decontamination.find_leaks(df, bench).collect()} == {1: [1], 2: [1], 3: []}
