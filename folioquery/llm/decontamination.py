"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages of up to 48 words. Their terms form the vocabulary; document
frequencies come from the whole corpus, and terms in over ``stop_share`` of all documents weigh nothing. A randomised SVD of TF-IDF passages (all of the benchmark, and a
bounded sample of the corpus) runs distributed: workers multiply their rows, the driver
orthonormalises matrices of terms x rank. The rank doubles until it keeps ``least_energy`` of every benchmark passage.

Every document is then cut into overlapping windows of 32 or 64 words, folded into the latent space and
compared with the passages by cosine. The cosine of a window sinks with the weight of the passage's terms, and so with every
further copy of an item in the corpus. So a second route goes by words alone: where a window and its margins hold enough of a passage's
words for ``least_overlap``, whatever these weigh, it is a candidate too. Candidates are checked on words: the longest common subsequence with the passage,
summed over an item's passages, must cover ``least_overlap`` of the item, and the item's answer (its ``answer`` column, else
its last eight words) must be there to ``least_answer``, so shared phrases alone are no leak. Every candidate window is judged on both,
so a copy without the answer does not hide another one that has it.

A long document is walked in stripes of blocks with the margins that a window needs, so memory follows neither texts nor the benchmark's size.

The benchmark is the stated query set: it is read in blocks of ``block_items`` items, each block against all rows.

Defined cases: null or empty texts have no leaks; items without words match nothing; repeated
items are reported each; repeated rows are judged alike; a null id is carried through. Ties between windows go to the
earlier. Input columns of documents are carried through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit

BLOCK = 16
#: Windows in blocks: for passages of up to 20 words, and for longer ones.
SCALES = (2, 4)
SHORT, LONG = 20, 48
#: Empty blocks behind each document: more than a window and its margins reach.
_APART = max(SCALES) + 2
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def term_hashes(words: kit.Words) -> np.ndarray:
    """Word hashes without ASCII punctuation at both ends."""
    s, e = words.start.copy(), words.end.copy()
    for _ in range(4):
        s += (s < e - 1) & _PUNCT[words.data[np.minimum(s, len(words.data) - 1)]] if len(s) else 0
        e -= (s < e - 1) & _PUNCT[words.data[e - 1]] if len(e) else 0
    return kit.string_hashes(words.data, s, e)


def terms_of(texts: list[str | None]) -> list[np.ndarray]:
    words = kit.Words(*kit.text_arrays(pa.array(texts, pa.string())), lower=True)
    h = term_hashes(words)
    return [h[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]


class Terms:
    """Exact look-up of term hashes: a table by the high bits, then a comparison."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.bits = max(16, int(np.ceil(np.log2(len(self.hashes) + 1))) + 4)
        prefix = self.hashes >> np.uint64(64 - self.bits)
        self.start = np.searchsorted(prefix, np.arange(1 << self.bits).astype(np.uint64)).astype(np.int32)
        self.depth = int(np.bincount(prefix.astype(np.int64)).max()) if len(prefix) else 0

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Term numbers, or -1."""
        out = np.full(len(h), -1, np.int64)
        if not len(self.hashes):
            return out
        at = self.start[(h >> np.uint64(64 - self.bits)).astype(np.int64)].astype(np.int64)
        for _ in range(self.depth):
            hit = self.hashes[np.minimum(at, len(self.hashes) - 1)] == h
            out[hit] = at[hit]
            at = np.minimum(at + 1, len(self.hashes) - 1)
        return out


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, one bit a word of ``a``."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        m = where.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@dataclass
class Counted:
    """Passages by their words, for candidates that no weight can hide."""

    #: Rows of ``passages`` and ``times`` of each term: the passages that count it, and how often at most.
    first: np.ndarray
    passages: np.ndarray
    times: np.ndarray
    #: Sorted passage x terms + term, and the term's places in the passage, a bit each.
    keys: np.ndarray
    places: np.ndarray
    sizes: np.ndarray
    #: How many of its most frequent words a passage does not count: these alone are in most windows.
    left_out: np.ndarray

    @classmethod
    def of(cls, words: list[np.ndarray], terms: Terms, seen: np.ndarray, least_overlap: float) -> Counted:
        sizes = np.array([len(p) for p in words], np.int64)
        passage = np.repeat(np.arange(len(words)), sizes)
        place = kit.ragged(np.zeros(len(words), np.int64), sizes)
        t = terms.find(np.concatenate([np.zeros(0, np.uint64), *words]))
        keys, at = np.unique(passage * len(terms) + t, return_inverse=True)
        places = np.zeros(len(keys), np.uint64)
        np.bitwise_or.at(places, at, np.uint64(1) << place.astype(np.uint64))
        left_out = (least_overlap * sizes / 2).astype(np.int64)
        order = np.lexsort((-seen[t], passage))
        counted, times = np.unique((t * len(words) + passage)[order][place >= left_out[passage]], return_counts=True)
        first = np.searchsorted(counted, np.arange(len(terms) + 1) * len(words))
        return cls(first, counted % max(1, len(words)), times, keys, places, sizes, left_out)

    def blocks(self, t: np.ndarray, block: np.ndarray, n_blocks: int) -> np.ndarray:
        """(blocks, passages): how many counted words of the passage the block holds."""
        n_terms, n = len(self.first) - 1, len(self.sizes)
        known = t >= 0
        keys, held = np.unique(block[known] * n_terms + t[known], return_counts=True)
        block, t = keys // n_terms, keys % n_terms
        out = np.zeros((n_blocks, n), np.uint8)
        step = max(1, (1 << 22) // n)
        for lo in range(0, n_blocks, step):
            hi = min(n_blocks, lo + step)
            a, b = np.searchsorted(block, [lo, hi])
            many = np.diff(self.first)[t[a:b]]
            rows = kit.ragged(self.first[t[a:b]], many)
            at = np.repeat((block[a:b] - lo) * n, many) + self.passages[rows]
            out[lo:hi] = np.bincount(at, np.minimum(self.times[rows], np.repeat(held[a:b], many)), (hi - lo) * n).reshape(-1, n)
        return out

    def common(self, passage: np.ndarray, lo: np.ndarray, hi: np.ndarray, t: np.ndarray) -> np.ndarray:
        """``common_subsequence`` of many passages with words lo .. hi - 1 at once."""
        full = (np.uint64(1) << self.sizes[passage].astype(np.uint64)) - np.uint64(1)
        v = full.copy()
        if not len(passage):
            return self.sizes[passage]
        # all look-ups at once, then only steps where a passage holds the word
        size = np.maximum(hi - lo, 0)
        row = np.repeat(np.arange(len(passage)), size)
        word = t[kit.ragged(lo, size)]
        row, word = row[word >= 0], word[word >= 0]
        key = passage[row] * (len(self.first) - 1) + word
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        held = np.flatnonzero(self.keys[at] == key)
        row, places = row[held], self.places[at[held]]
        # the n-th held word of every row together
        start = np.searchsorted(row, np.arange(len(passage)))
        turn = np.arange(len(row)) - start[row]
        order = np.argsort(turn.astype(np.uint16), kind="stable") if len(turn) else turn
        edge = np.searchsorted(turn[order], np.arange(int(turn.max()) + 2)) if len(turn) else [0]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            r = row[order[a:b]]
            u = v[r] & places[order[a:b]]
            v[r] = ((v[r] + u) | (v[r] - u)) & full[r]
        return self.sizes[passage] - np.bitwise_count(v)


@dataclass
class Index:
    terms: Terms
    weights: np.ndarray
    rest: float
    basis: np.ndarray
    passages: np.ndarray
    scale: np.ndarray
    words: list[list[int]]
    item_of: np.ndarray
    items: list
    lengths: np.ndarray
    answers: list[list[int]]
    energy: float
    #: Weighted terms by passages where there are few passages, else weighted terms by basis.
    table: np.ndarray
    direct: bool | None
    counted: Counted


#: An array that all tasks add to is cut into so many blocks, each summed by one task.
_BLOCKS = 16


def _addend(total: np.ndarray) -> pa.RecordBatch:
    """One task's part of a distributed sum: a row a block."""
    parts = np.array_split(total.reshape(-1), _BLOCKS)
    return pa.RecordBatch.from_arrays([pa.array(range(_BLOCKS), pa.int32()), kit.binaries([p.tobytes() for p in parts])], ["slot", "x"])


def _sum_rows(parts: DataFrame, dtype: str) -> np.ndarray | None:
    """The sum of all tasks' arrays: blocks are added up by executors, and the driver gets the sum once."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, raw in zip(batch.column("slot").to_pylist(), batch.column("x").to_pylist(), strict=True):
                x = np.frombuffer(raw, dtype)
                total[slot] = total[slot] + x if slot in total else x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), kit.binaries([x.tobytes() for x in total.values()])], ["slot", "x"])

    got = {r[0]: np.frombuffer(bytes(r[1]), dtype) for r in parts.repartition("slot").transform(kit.mapping, add, "slot int, x binary").collect()}
    return np.concatenate([got[k] for k in sorted(got)]) if got else None


def _frequencies(docs: DataFrame, terms: Terms) -> tuple[np.ndarray, int]:
    """In how many documents of the corpus each term is, and how many documents there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms) + 1, np.int64)
        for batch in batches:
            for a, b, data, bounds in kit.slices(batch.column(0)):
                words = kit.Words(data, bounds, lower=True)
                t = terms.find(term_hashes(words))
                doc = np.repeat(np.arange(b - a), words.counts)[t >= 0]
                seen = np.unique(doc * (len(terms) + 1) + t[t >= 0])
                total += np.bincount(seen % (len(terms) + 1), minlength=len(terms) + 1)
                total[-1] += b - a
        yield _addend(total.astype("<i8"))

    got = _sum_rows(docs.select("text").transform(kit.mapping, count, "slot int, x binary"), "<i8")
    return (got[:-1], int(got[-1])) if got is not None else (np.zeros(len(terms), np.int64), 0)


def _vectors(rows: list[np.ndarray], terms: Terms, weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for h in rows:
        t = terms.find(h)
        ids, n = np.unique(t[t >= 0], return_counts=True)
        w = n * weights[ids]
        out.append((ids, w / max(1e-12, np.sqrt((w * w).sum()))))
    return out


def randomised_svd(rows: DataFrame, size: int, rank: int, rounds: int = 2, seed: int = 5) -> np.ndarray:
    """The leading right singular vectors (size x rank) of sparse rows (ids, values), by distributed subspace iteration."""
    width = min(size, rank + 8)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0].astype(np.float32)

    def times(q: np.ndarray, gram: bool) -> np.ndarray:
        shared = rows.sparkSession.sparkContext.broadcast(q)  # terms x rank: no part of it grows with the corpus

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, total = shared.value, None
            for batch in batches:
                for ids, values in zip(batch.column("ids").to_pylist(), batch.column("vals").to_pylist(), strict=True):
                    i, v = np.frombuffer(ids, "<i4"), np.frombuffer(values, "<f4")
                    y = v @ q[i]
                    if total is None:
                        total = np.zeros((q.shape[1] if gram else size, q.shape[1]), "<f4")
                    total[slice(None) if gram else i] += np.outer(y if gram else v, y)
            if total is not None:
                yield _addend(total)

        got = _sum_rows(rows.transform(kit.mapping, multiply, "slot int, x binary"), "<f4")
        shared.destroy()
        return (got if got is not None else np.zeros(q.shape[1] * (q.shape[1] if gram else size))).reshape(-1, q.shape[1])

    for _ in range(rounds):
        basis = np.linalg.qr(times(basis, False))[0].astype(np.float32)
    values, vectors = np.linalg.eigh(times(basis, True))
    return (basis @ vectors[:, np.argsort(-values)[:rank]]).astype(np.float32)


def _cut_passages(h: np.ndarray) -> list[np.ndarray]:
    return [p for p in np.array_split(h, max(1, -(-len(h) // LONG))) if len(p)]


def fit(docs: DataFrame, items: list[tuple], rank: int = 512, sample: int = 4096, least_energy: float = 0.9, stop_share: float = 0.1, least_terms: int = 6, least_overlap: float = 0.6) -> Index:
    """Build the index for a block of items (item_id, text, answer or None)."""
    spark = docs.sparkSession
    all_words = terms_of([x[1] for x in items])
    answers = [a if len(a) else w[-8:] for a, w in zip(terms_of([x[2] for x in items]), all_words, strict=True)]
    words, item_of = [], []
    for k, h in enumerate(all_words):
        for p in _cut_passages(h):
            words.append(p)
            item_of.append(k)
    terms = Terms(np.concatenate([np.zeros(0, np.uint64), *words]))
    seen, n_docs = _frequencies(docs, terms)
    weights = np.log1p(n_docs / (seen + 1.0)) + 1e-3
    # Stop terms weigh nothing, but for passages that would keep too few others.
    stop = seen > stop_share * n_docs
    if stop.any():
        for p in words:
            t = terms.find(p)
            if len(np.unique(t[~stop[t]])) < least_terms:
                stop[t] = False
    weights[stop] = 0.0
    rest = float(np.median(weights[~stop])) if len(weights) else 1.0
    vectors = _vectors(words, terms, weights)

    n_rows = max(1, n_docs)
    chosen = docs.select("doc_id", "text").where(F.expr(f"pmod(xxhash64(doc_id, text, 23), 1048576) < {min(1.0, sample / n_rows) * 1048576}"))

    def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h in terms_of(batch.column(1).to_pylist()):
                if len(h):
                    at = int(h[0] % np.uint64(max(1, len(h) - LONG)))  # one window a sampled document, anywhere in it
                    rows.append(h[at : at + LONG])
            got = _vectors(rows, terms, weights)
            yield pa.RecordBatch.from_arrays([kit.binaries([i.astype("<i4").tobytes() for i, _ in got]), kit.binaries([(v * 0.25).astype("<f4").tobytes() for _, v in got])], ["ids", "vals"])

    kind = "ids binary, vals binary"
    of_items = spark.createDataFrame([(bytearray(i.astype("<i4").tobytes()), bytearray(v.astype("<f4").tobytes())) for i, v in vectors], kind)
    rows = kit.written(chosen.transform(kit.mapping, window_rows, kind).unionByName(of_items), "svd-rows")
    rank = min(rank, max(1, len(terms)))
    while True:
        basis = randomised_svd(rows, len(terms), rank) if len(terms) else np.zeros((0, 1), np.float32)
        folded = np.stack([v.astype(np.float32) @ basis[i] for i, v in vectors]) if vectors else np.zeros((0, basis.shape[1]), np.float32)
        energy = float((folded**2).sum(1).min()) if len(folded) else 1.0
        if energy >= least_energy or rank >= len(terms):
            break
        rank = min(2 * rank, len(terms))
    folded /= np.maximum(1e-9, np.linalg.norm(folded, axis=1, keepdims=True))
    scale = np.array([0 if len(w) <= SHORT else 1 for w in words], np.int64)
    direct = len(folded) <= 2 * basis.shape[1] or None
    table = (weights[:, None] * (basis @ folded.T if direct else basis)).astype(np.float32)
    if direct:
        basis = basis[:0]  # not needed by searches
    return Index(terms, weights, rest, basis, folded, scale, [w.tolist() for w in words], np.array(item_of, np.int64), [x[0] for x in items], np.array([len(w) for w in all_words]), [a.tolist() for a in answers], energy, table, direct, Counted.of(words, terms, seen, least_overlap))


#: A document's and item's windows: (passage, first block) to (length of the subsequence, cosine, - first word, last word, share of the answer).
Judged = dict[tuple[int, int], dict[tuple[int, int], tuple]]
#: Cells of an array of blocks x passages.
_CELLS = 6 << 20


def slice_bytes(index: Index) -> int:
    """Bytes of text whose blocks (of some 96 bytes) fill ``_CELLS`` with the index's passages."""
    return max(1 << 13, min(kit.SLICE_BYTES, 96 * _CELLS // max(1, len(index.passages))))


def _candidates(index: Index, words: kit.Words, least_cosine: float, least_overlap: float, lead: int = 0, core: int | None = None, parts_of_items: set[int] | None = None) -> tuple[Judged, set]:
    """Judged windows by (document, item), and the (document, item) of which a passage among others is there.

    Of a stripe only windows from block ``lead`` to ``core`` count, and the other passages of items come in a pass of their own, which
    gets the items to look for; without a stripe both are done at once.
    """
    n = len(words.bounds) - 1
    stripe = core is not None
    h = term_hashes(words)
    t = index.terms.find(h)
    known = t >= 0
    # blocks of BLOCK words, none across documents; empty ones keep documents apart, so that windows are sums of shifted rows
    blocks = -(-words.counts // BLOCK)
    first_block = np.concatenate([[0], np.cumsum(blocks + _APART)])
    n_blocks = int(first_block[-1])
    word = kit.ragged(words.first[:-1], words.counts)
    doc = np.repeat(np.arange(n), words.counts)
    block = first_block[doc] + (word - words.first[doc]) // BLOCK
    square = np.where(known, index.weights[t] ** 2, index.rest**2)
    sums = np.concatenate([[0], np.cumsum(np.bincount(block, square, n_blocks))])
    block_doc = np.repeat(np.arange(n), blocks + _APART)
    word_edge = np.searchsorted(block, np.arange(n_blocks + 1))
    # (weighted terms x basis) x passages, in whichever order is cheaper
    seen = np.flatnonzero(known & (index.weights[t] > 0))
    parts = np.zeros((n_blocks, index.table.shape[1]), np.float32)
    place = np.arange(len(seen)) - np.searchsorted(block[seen], block[seen])
    for k in range(BLOCK):  # the k-th word of every block at once
        one = seen[place == k]
        if not len(one):
            break
        parts[block[one]] += index.table[t[one]]
    begin, last = np.arange(n_blocks), (first_block[:-1] + blocks)[block_doc]
    real = begin < last
    if stripe:
        real &= (begin >= lead) & (begin < core)
    alone = np.bincount(index.item_of, minlength=len(index.items)) == 1
    counted = index.counted
    least = np.maximum(1, np.ceil(least_overlap * counted.sizes - 1e-9)).astype(np.int64)
    matched = counted.blocks(t, block, n_blocks)
    parts_found: set[tuple[int, int]] = set()
    hits: list[tuple[np.ndarray, ...]] = []  # passages, their cosine, first block, words from and to, length of the subsequence
    for s, width in enumerate(SCALES):
        rows = np.flatnonzero(index.scale == s)
        if not len(rows):
            continue
        # a window begins at each block; near a document's end it is shorter
        stop = np.where(real, np.minimum(begin + width, last), begin)
        norm = np.where(real, np.sqrt(np.maximum(sums[stop] - sums[:-1], 1e-12)), np.inf).astype(np.float32)
        mine = parts if index.direct is None or len(rows) == parts.shape[1] else parts[:, rows]
        x = mine.copy()
        for k in range(1, width):
            x[:-k] += mine[k:]
        if index.direct is None:
            x = x @ index.passages[rows].T
        near = x >= least_cosine * norm[:, None]
        # by words alone: windows with their margins, a block at each side
        held = matched[:, rows]
        y = held.copy()
        y[1:] += held[:-1]
        for k in range(1, width + 1):
            y[:-k] += held[k:]
        from_word = np.maximum(words.first[block_doc], word_edge[begin] - BLOCK)
        to_word = np.minimum(words.first[block_doc + 1], word_edge[stop] + BLOCK)

        def take(i: np.ndarray, k: np.ndarray, length: np.ndarray) -> None:
            hits.append((rows[k], x[i, k] / norm[i], i, from_word[i], to_word[i], length))  # noqa: B023

        apart = ~alone[index.item_of[rows]]
        place_of = np.full(len(index.item_of), -1)
        place_of[rows] = np.arange(len(rows))
        if parts_of_items is None:
            i, k = np.nonzero(near)
            length = counted.common(rows[k], from_word[i], to_word[i], t)
            some = length >= np.where(apart[k], 1, least[rows[k]])
            take(i[some], k[some], length[some])
            i, k = np.nonzero((y >= np.maximum(1, least - counted.left_out)[rows]) & real[:, None] & (~near | apart))
            common = counted.common(rows[k], from_word[i], to_word[i], t)
            enough = common >= least[rows[k]]
            new = enough & ~near[i, k]
            take(i[new], k[new], common[new])
            parted = enough & apart[k]
            these = set(zip(block_doc[i[parted]].tolist(), index.item_of[rows[k[parted]]].tolist(), strict=True))
            parts_found |= these
            if stripe:
                continue
        else:
            these = {(0, item) for item in parts_of_items}
        # the other passages of an item in parts: their best window, and all that are enough by themselves
        for d, item in these:
            at = np.arange(first_block[d], first_block[d] + blocks[d])
            at = at[real[at]]
            for other in np.flatnonzero((index.item_of == item) & (place_of >= 0)):
                length = counted.common(np.full(len(at), other), from_word[at], to_word[at], t)
                chosen = np.union1d(np.flatnonzero(length >= least[other]), [np.argmax(length)])
                take(at[chosen], np.full(len(chosen), place_of[other]), length[chosen])
    # every candidate window is judged, for overlap and for the answer: a longer copy may lack the answer that another has
    judged: Judged = {}
    for p, cosine, b, lo, hi, length in (row for h_ in hits for row in zip(*(z.tolist() for z in h_), strict=True)):
        item = int(index.item_of[p])
        there = common_subsequence(index.answers[item], h[lo:hi].tolist()) / max(1, len(index.answers[item]))
        judged.setdefault((int(block_doc[b]), item), {})[p, b] = (length, cosine, -lo, hi, there)
    return judged, parts_found


def _stripes(index: Index, data: np.ndarray, least_cosine: float, least_overlap: float, size: int) -> Judged:
    """Judged windows of one long document, read in stripes of whole blocks with the margins that windows need."""
    margin = max(SCALES) + 1
    out: Judged = {}
    parted: set[tuple[int, int]] = set()

    def each() -> Iterator[tuple[kit.Words, int, int, int]]:
        """Words of a stripe, the number of its first block, and which of its blocks begin windows."""
        at, block, lead, stop = 0, 0, 0, size
        while at < len(data):
            stop = min(max(stop, at + size), len(data))
            while stop < len(data) and not _BLANK[data[stop]]:  # to the end of a word
                ahead = np.flatnonzero(_BLANK[data[stop : stop + size]])
                stop += int(ahead[0]) if len(ahead) else min(size, len(data) - stop)
            words = kit.Words(data[at:stop], np.array([0, stop - at]), lower=True)
            whole = len(words.start) // BLOCK
            if stop == len(data):
                yield words, block, lead, whole + 1
                return
            if whole <= lead + margin:  # too few words in so many bytes
                stop += size
                continue
            core = whole - margin
            yield words, block, lead, core
            at, block, lead = at + int(words.start[(core - 1) * BLOCK]), block + core - 1, 1

    def add(words: kit.Words, block: int, lead: int, core: int, items: set[int] | None) -> Iterator[tuple[int, int, int, tuple]]:
        judged, found = _candidates(index, words, least_cosine, least_overlap, lead, core, items)
        parted.update(found)
        for (_, item), seen_at in judged.items():
            for (p, b), (length, cosine, lo, hi, there) in seen_at.items():
                yield item, p, b + block, (length, cosine, lo - block * BLOCK, hi + block * BLOCK, there)

    for words, block, lead, core in each():
        if len(words.start):
            for item, p, b, x in add(words, block, lead, core, None):
                out.setdefault((0, item), {})[p, b] = x
    items = {item for _, item in parted}
    if items:
        least = np.maximum(1, np.ceil(least_overlap * index.counted.sizes - 1e-9))
        others: dict[tuple[int, int], list[tuple]] = {}
        for words, block, lead, core in each():
            if len(words.start):
                for item, p, b, x in add(words, block, lead, core, items):
                    others.setdefault((item, p), []).append((b, x))
        for (item, p), rows in others.items():
            best = max(x[0] for _, x in rows)
            kept = [r for r in rows if r[1][0] >= least[p]] or [next(r for r in rows if r[1][0] == best)]
            out.setdefault((0, item), {}).update({(p, b): x for b, x in kept})
    return out


def search(index: Index, data: np.ndarray, bounds: np.ndarray, least_cosine: float, least_overlap: float, least_answer: float, stripe: int | None = None) -> list[list[dict]]:
    """Leaks of each document. Arrays of blocks x passages are bounded: a longer document is read in stripes of so many bytes."""
    stripe = stripe or slice_bytes(index)
    n = len(bounds) - 1
    found: list[list[dict]] = [[] for _ in range(n)]
    if not len(index.passages):
        return found
    if n == 1 and len(data) > 2 * stripe:
        judged, start = _stripes(index, data, least_cosine, least_overlap, stripe), [0]
    else:
        words = kit.Words(data, bounds, lower=True)
        if not len(words.start):
            return found
        judged, start = _candidates(index, words, least_cosine, least_overlap)[0], words.first.tolist()
    alone = np.bincount(index.item_of, minlength=len(index.items)) == 1
    for (d, item), seen_at in sorted(judged.items()):
        if alone[item]:
            parts_of = [max((x for x in seen_at.values() if x[4] >= least_answer), default=None)]
            if parts_of[0] is None:
                continue
        else:
            parts_of = [max(x for (q, _), x in seen_at.items() if q == p) for p in sorted({q for q, _ in seen_at})]
        overlap = sum(x[0] for x in parts_of) / index.lengths[item]
        there = parts_of[0][4] if alone[item] else max(x[4] for x in seen_at.values())
        if overlap >= least_overlap and there >= least_answer:
            lo, hi = min(-x[2] for x in parts_of), max(x[3] for x in parts_of)
            found[d].append({"item_id": index.items[item], "start": lo - start[d], "end": hi - start[d], "cosine": max(x[1] for x in parts_of), "overlap": float(overlap), "answer": float(there)})
    return found


LEAK = "struct<item_id:long,start:int,end:int,cosine:double,overlap:double,answer:double>"
_LEAK = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("cosine", pa.float64()), ("overlap", pa.float64()), ("answer", pa.float64())]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, least_cosine: float = 0.35, least_overlap: float = 0.6, least_answer: float = 0.5, block_items: int = 4096, **limits: float) -> DataFrame:
    """All columns of ``docs``, then ``leaks``: an array of (item_id, start, end, cosine, overlap, answer) with word positions."""
    kit.bound_batches(docs.sparkSession)
    columns = [c.lower() for c in benchmark.columns]
    answer = F.col("answer") if "answer" in columns else F.lit(None)
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"), answer.cast("string"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    where = {c.lower(): i for i, c in reversed(list(enumerate(docs.columns)))}
    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True))
    out = docs.toDF(*names).withColumn("leaks", F.expr(f"cast(array() as array<{LEAK}>)"))
    corpus = docs.toDF(*names).select(F.col(names[where["doc_id"]]).alias("doc_id"), F.col(names[where["text"]]).cast("string").alias("text"))

    def with_block(out: DataFrame, block: list[tuple]) -> DataFrame:
        index = docs.sparkSession.sparkContext.broadcast(fit(corpus, block, least_overlap=least_overlap, **limits))  # a block of items: bounded

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for _, _, data, bounds in kit.slices(batch.column(where["text"]), slice_bytes(index.value)):
                    found += search(index.value, data, bounds, least_cosine, least_overlap, least_answer)
                before = batch.column(batch.num_columns - 1).to_pylist()
                leaks = pa.array([(b or []) + f for b, f in zip(before, found, strict=True)], _LEAK)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], leaks], batch.schema.names)

        return out.transform(kit.mapping, look, f"{kinds}, leaks array<{LEAK}>")

    block: list[tuple] = []
    for row in items.toLocalIterator():
        block.append(tuple(row))
        if len(block) == block_items:
            out, block = with_block(out, block), []
    if block:
        out = with_block(out, block)
    return out.toDF(*docs.columns, "leaks")
