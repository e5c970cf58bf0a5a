"""Interpolated modified Kneser-Ney language model: counted in Spark, kept as sorted hash arrays, memory-mapped.

The order is 2 or 3. A word's id follows from the rank of its 64-bit hash in the vocabulary's sorted array, and an n-gram is a row of ids until
it is stored under a 64-bit hash of them. Ids, counts and sums are 64 bits wide. Both counting passes collapse equal keys in the
map task before the shuffle. N-grams go to shards by their middle word, so that a shard has all that Kneser-Ney needs of them: how
often a context occurs and with how many words, and before a pair how many words. The n-grams of a frequent
middle word are dealt over as many shards as its share of the corpus asks for; what they say of contexts and pairs is merged in a second, small step.

Shards are written as flat files in the shared folder (a temporary name, then a rename, so a retried
task leaves one copy) and mapped read-only by the scoring workers; where the folder is no mount, workers read the pages that they need. Nothing
that grows with the corpus reaches the driver but shard sizes, counts of counts and the frequent words, of which there are at most ``_DEAL`` a shard.

    p(w | uv) = max(c(uvw) - D(c(uvw)), 0) / c(uv.) + gamma(uv) * p(w | v)
    p(w | v)  = max(N(.vw) - D'(N(.vw)), 0) / N(.v.) + gamma'(v) * p(w)
    p(w)      = max(N(.w) - D''(N(.w)), 0) / N(..) + gamma'' / (V + 1)

N counts distinct left neighbours (for order 2, and for pairs at a text's start, which nothing precedes: occurrences); D are the modified discounts from
counts of counts. A text starts in the sentence-start context, so its first word is scored by pairs, and ends with an end token, which is
scored too. An unknown word gets the uniform share; after an unknown context the shorter one is used.

Two of n words share a hash with a chance of about n * n / 2**65, and an n-gram that was never seen is taken for one that was with a chance of about 2**-28.

Defined cases: a null or empty text is the end token alone; every row trains and is scored on its own, so
repeated rows count each; without any training text every token is unknown (score 0 for V = 0, as p = 1/(V + 1)). A null
doc_id is carried through. Other input columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kit

#: Hash of the end token; no word is empty, so it is free.
END = np.uint64(0xE17A1465B9C04D2F)
#: Ids: the start context, nothing (before the start), and words that were not seen; words count from ``FIRST``.
START, NONE, UNKNOWN, FIRST = 0, 1, -1, 2
#: A word of 1 / (_DEAL * shards) of the corpus or more is dealt over several shards.
_DEAL = 4
_KEY = np.uint64(0x9E3779B97F4A7C15)


def tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (each document's words, then the end) and each document's first token number, total last."""
    words = kit.Words(data, bounds, lower=True)
    n = len(bounds) - 1
    first = words.first + np.arange(n + 1)
    out = np.full(first[-1], END, np.uint64)
    real = np.ones(len(out), bool)
    real[first[1:] - 1] = False
    out[real] = words.hashes()
    return out, first


def gram(*ids: np.ndarray) -> np.ndarray:
    """The hash of an n-gram of ids."""
    out = np.full(len(ids[0]), len(ids), np.uint64)
    with np.errstate(over="ignore"):
        for x in ids:
            out = kit.mix(out * _KEY + x.astype(np.uint64))
    return out


def _squeeze(*columns: np.ndarray) -> bytes:
    """64-bit columns byte by byte: the high bytes of small numbers vanish, and those of sorted ones nearly."""
    planes = [np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for x in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _open(block: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8).reshape(columns, 8, -1)
    return [np.ascontiguousarray(x.T).view("<u8").reshape(-1).astype(np.int64) for x in raw]


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of the (sorted) keys begins."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _collapse(keys: list[np.ndarray], n: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of ids, sorted by the first key first, and the sums of their counts (None: one each).

    The first key goes by its number among its distinct values. If a row fits into 64 bits then, values are sorted; else row numbers.
    """
    total = len(keys[0])
    if not total:
        return keys, np.zeros(0, np.int64)
    head = _runs(keys[0])
    first, code = np.unique(keys[0][head], return_inverse=True)
    codes = [np.repeat(code, np.diff(np.append(head, total))), *keys[1:]]
    bits = [max(1, int(k.max()).bit_length()) for k in codes]
    if sum(bits) <= 64:
        packed = np.zeros(total, np.uint64)
        for k, b in zip(codes, bits, strict=True):
            packed = packed << np.uint64(b) | k.astype(np.uint64)
        sorted_ = np.sort(packed)
        edge = _runs(sorted_)
        count, one = np.diff(np.append(edge, total)), sorted_[edge]
        if n is not None:
            more = np.flatnonzero(n != 1)
            np.add.at(count, np.searchsorted(one, packed[more]), n[more] - 1)
        out = []
        for b in reversed(bits):
            out.append((one & np.uint64((1 << b) - 1)).astype(np.int64))
            one = one >> np.uint64(b)
        return [first[out[-1]], *out[-2::-1]], count
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    edge = _runs(*keys)
    return [k[edge] for k in keys], np.diff(np.append(edge, total)) if n is None else np.add.reduceat(n[order], edge)


def _rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), kit.binaries([r[1] for r in rows])], ["shard", "block"])


def _by_shard(shard: np.ndarray) -> np.ndarray:
    """A stable order by shard; 16-bit numbers are sorted by counting."""
    return np.argsort(shard.astype(np.uint16) if len(shard) and shard.min() >= 0 and shard.max() < 1 << 16 else shard, kind="stable")


def _dealt(shard: np.ndarray, *columns: np.ndarray, kind: bytes = b"") -> Iterator[pa.RecordBatch]:
    """Rows to their shards, a block each, in the order they are in."""
    if not len(shard):
        return
    order = _by_shard(shard)
    shard, columns = shard[order], [c[order] for c in columns]
    cut = _runs(shard)
    for a, b in zip(cut, np.append(cut[1:], len(shard)), strict=True):
        yield _rows([(int(shard[a]), kind + _squeeze(*(c[a:b] for c in columns)))])


def _grouped(sent: DataFrame, finish: Callable[[int, list[bytes]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Bring the blocks of each shard together and finish them."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, now = [], None
        for batch in batches:
            for shard, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if shard != now:
                    if blocks:
                        yield from finish(now, blocks)
                    blocks, now = [], shard
                blocks.append(block)
        if blocks:
            yield from finish(now, blocks)

    return sent.repartition("shard").sortWithinPartitions("shard").transform(kit.mapping, gather, schema)


# ---------------------------------------------------------------- stored arrays


def pack_table(keys: np.ndarray, values: np.ndarray) -> bytes:
    """A sorted array of distinct 64-bit keys with rows of values, as bytes.

    The top bits of a key are its bucket, of which an array holds the starts; the next 32 bits are stored. Rows of values repeat a
    lot, so each key has the number of its row among the distinct ones.
    """
    order = kit.order_of(keys)
    keys, values = keys[order], np.ascontiguousarray(values[order].astype("<u8"))
    n = len(keys)
    bits = min(48, max(0, n.bit_length() - 3))
    number = values[:, 0]
    for k in range(1, values.shape[1]):
        number = kit.mix(kit.mix(number) + values[:, k])
    _, code = kit.distinct(number)
    at = np.zeros(int(code.max()) + 1 if n else 0, np.int64)
    at[code] = np.arange(n)
    narrow = next(t for t in ("<u1", "<u2", "<u4", "<u8") if len(at) <= 1 << 8 * np.dtype(t).itemsize)
    start = np.searchsorted(keys >> np.uint64(64 - bits) if bits else np.zeros(n, np.uint64), np.arange((1 << bits) + 1, dtype=np.uint64))
    wide = "<u4" if n < 2**32 else "<u8"
    deepest = int(np.diff(start).max()) if n else 0
    head = np.array([n, bits, np.dtype(wide).itemsize, np.dtype(narrow).itemsize, len(at), values.shape[1], deepest, 0], "<i8")
    rest = ((keys << np.uint64(bits)) >> np.uint64(32)).astype("<u4")
    return b"".join([head.tobytes(), values[at].tobytes(), start.astype(wide).tobytes(), rest.tobytes(), code.astype(narrow).tobytes()])


class Table:
    """Look-ups in a stored table; only what a look-up touches is read."""

    def __init__(self, uri: str):
        head = kit.map_file(uri, "<i8", 0, 8).take(np.arange(8))
        n, bits, wide, narrow, rows, columns, deepest, _ = head.tolist()
        self.n, self.bits, self.steps = n, bits, deepest.bit_length()
        at = 64 + 8 * rows * columns
        self.book = kit.map_file(uri, "<u8", 64, rows * columns).take(np.arange(rows * columns)).reshape(rows, columns).astype(np.int64)
        self.start = kit.map_file(uri, f"<u{wide}", at, (1 << bits) + 1)
        at += wide * ((1 << bits) + 1)
        self.rest = kit.map_file(uri, "<u4", at, n)
        self.code = kit.map_file(uri, f"<u{narrow}", at + 4 * n, n)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which keys are there, the rows of values of those); sorted keys are read in order."""
        if not self.n or not len(keys):
            return np.zeros(len(keys), bool), np.zeros((0, self.book.shape[1]), np.int64)
        bucket = (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        low, high = self.start.take(bucket).astype(np.int64), self.start.take(bucket + 1).astype(np.int64)
        want, end = ((keys << np.uint64(self.bits)) >> np.uint64(32)).astype(np.uint32), high
        for _ in range(self.steps):
            middle = (low + high) >> 1
            less = (self.rest.take(np.minimum(middle, self.n - 1)) < want) & (low < high)
            low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
        hit = (low < end) & (self.rest.take(np.minimum(low, self.n - 1)) == want)
        return hit, self.book[self.code.take(low[hit]).astype(np.int64)]


class Tables:
    """The shards' tables of one kind, opened when they are first asked."""

    def __init__(self, root: str, kind: str, columns: int):
        self.root, self.kind, self.columns = root, kind, columns
        self.open: dict[int, Table] = {}

    def find(self, keys: np.ndarray, shard: np.ndarray, shards: int) -> np.ndarray:
        """Rows of values of keys; zeros where a key is unknown."""
        out = np.zeros((len(keys), self.columns), np.int64)
        order = _by_shard(shard)
        edge = np.searchsorted(shard[order], np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(edge)).tolist():
            at = order[edge[s] : edge[s + 1]]
            at = at[kit.order_of(keys[at])]  # neighbours lie on the same pages
            if s not in self.open:
                if len(self.open) >= 2000:  # maps a process may hold
                    self.open.pop(next(iter(self.open)))
                self.open[s] = Table(f"{self.root}/{self.kind}-{s}")
            hit, values = self.open[s].find(keys[at])
            out[at[hit]] = values
        return out


class Vocabulary:
    """Word hashes to ids (ranks, from ``FIRST``), with counts; shards are equal ranges of hashes."""

    def __init__(self, root: str, sizes: list[int]):
        self.sizes, self.base = sizes, np.concatenate([[0], np.cumsum(sizes)]) + FIRST
        self.hashes = [kit.map_file(f"{root}/words-{s}", "<u8", 0, n) for s, n in enumerate(sizes)]
        self.counts = [kit.map_file(f"{root}/counts-{s}", "<u8", 0, n) for s, n in enumerate(sizes)]

    @staticmethod
    def shard(hashes: np.ndarray, shards: int) -> np.ndarray:
        return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or UNKNOWN, count) of sorted hashes."""
        ids, counts = np.full(len(hashes), UNKNOWN, np.int64), np.zeros(len(hashes), np.int64)
        edge = np.searchsorted(self.shard(hashes, len(self.sizes)), np.arange(len(self.sizes) + 1))
        for s, n in enumerate(self.sizes):
            a, b = edge[s], edge[s + 1]
            if a < b and n:
                at = kit.search_sorted(self.hashes[s], n, hashes[a:b])
                hit = self.hashes[s].take(np.minimum(at, n - 1)) == hashes[a:b]
                ids[a:b][hit] = at[hit] + self.base[s]
                counts[a:b][hit] = self.counts[s].take(at[hit])
        return ids, counts

    def ids_of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, back = kit.distinct(hashes)
        ids, counts = self.find(found)
        return ids[back], counts[back]


# ---------------------------------------------------------------- counting


@dataclass
class Model:
    root: str
    order: int
    vocabulary: list[int]
    shards: int
    #: Sorted ids of frequent words (and the start), and over how many shards each is dealt.
    heavy: np.ndarray
    spread: np.ndarray
    tokens: int
    #: How many different pairs there are.
    bigrams: int
    #: By length of the n-gram, from 1.
    discounts: list[tuple[float, float, float]]
    #: How many words follow one, two, and three or more others.
    singles: tuple[int, int, int]

    def spread_of(self, v: np.ndarray) -> np.ndarray:
        """Over how many shards the n-grams with these middle words are dealt."""
        if not len(self.heavy):
            return np.ones(len(v), np.int64)
        at = np.minimum(np.searchsorted(self.heavy, v), len(self.heavy) - 1)
        return np.where(self.heavy[at] == v, self.spread[at], 1)

    def shard(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """By the middle word; where that is dealt, by both others too."""
        head = _runs(v)
        size, v = np.diff(np.append(head, len(v))), v[head]
        spread = self.spread_of(v)
        out = np.repeat((gram(v, np.zeros(len(v), np.int64)) % np.uint64(self.shards)).astype(np.int64), size)
        spread, many = np.repeat(spread, size), np.flatnonzero(np.repeat(spread > 1, size))
        part = (gram(u[many], w[many]) % spread[many].astype(np.uint64)).astype(np.int64)
        out[many] = (gram(np.repeat(v, size)[many], part) % np.uint64(self.shards)).astype(np.int64)
        return out

    def pair_shard(self, keys: np.ndarray, middle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shard of a pair's or context's row, whether it is merged from several shards)."""
        apart = self.spread_of(middle) > 1
        shard = (gram(middle, np.zeros(len(middle), np.int64)) % np.uint64(self.shards)).astype(np.int64)
        return np.where(apart, (keys % np.uint64(self.shards)).astype(np.int64), shard), apart


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from counts of counts n1..n4; kept within 0..count."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.0
    return tuple(min(float(k), max(0.0, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] else 0.0 for k in (1, 2, 3))


def _discounted(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    c = c.astype(np.float64)
    return np.where(c > 0, c - np.choose(np.minimum(c, 3).astype(np.int64), [0.0, *d]), 0.0)


def _of_counts(values: np.ndarray) -> list[int]:
    """How many values are 1, 2, 3 and 4."""
    return np.bincount(np.minimum(values, 5), minlength=6)[1:5].tolist()


def _sums(values: np.ndarray, edge: np.ndarray) -> list[np.ndarray]:
    """Per run: the total, and how many values are one, two, and more."""
    return [np.add.reduceat(x.astype(np.int64), edge) for x in (values, values == 1, values == 2, values >= 3)] if len(edge) else [np.zeros(0, np.int64)] * 4


def _left(ids: np.ndarray, first: np.ndarray, by: int) -> np.ndarray:
    """The id ``by`` tokens before each token: START just before a document, NONE beyond."""
    out = np.full(len(ids), NONE, np.int64)
    out[by:] = ids[: len(ids) - by]
    for k in range(by):  # the first tokens of each document
        at = first[:-1] + k
        at = at[at < first[1:]]
        out[at] = START if k == by - 1 else NONE
    return out


_SUMMARY, _CONTEXTS, _PAIRS, _WORDS = b"s", b"c", b"p", b"w"


def train(docs: DataFrame, usable: Column | None = None, order: int = 3, flush_tokens: int = 2_000_000) -> Model:
    """Count the model over all rows where ``usable`` holds; ``docs`` needs doc_id and text."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = docs.sparkSession
    kit.bound_batches(spark)
    shards = kit.partitions(spark)
    root = f"{kit.shared_dir(spark)}/ngrams-{uuid.uuid4().hex}"
    rows = docs if usable is None else docs.where(usable)
    rows = rows.select(F.col("text").cast("string").alias("text"))

    sizes, total, documents = _count_words(rows, root, shards, flush_tokens)
    model = Model(root, order, sizes, shards, np.zeros(0, np.int64), np.zeros(0, np.int64), total, 0, [(0.0, 0.0, 0.0)] * order, (0, 0, 0))
    if not total:
        return model
    model.heavy, model.spread = _frequent(spark, root, sizes, documents, max(1000, total // (_DEAL * shards)))

    partial = kit.written(_grouped(_count_grams(rows, model, flush_tokens), _gram_shard(model), "shard int, block binary"), "ngram-stats", "none")
    kinds = F.expr("cast(substring(block, 1, 1) as string)")
    merged = kit.written(_grouped(partial.where(kinds.isin("c", "p")), _merged_shard(model), "shard int, block binary"), "ngram-stats", "none")
    both = partial.unionByName(merged).where(kinds.isin("w", "s"))
    summary = np.zeros((4, 6), np.int64)  # counts of counts by length; for words also how many pairs there are, and words that follow three or more
    for _, block in _grouped(both, _stats_shard(model), "shard int, block binary").collect():  # one short row a shard
        summary += np.frombuffer(bytes(block), "<i8").reshape(4, 6)
    model.bigrams = int(summary[1, 4])
    model.discounts = [discounts(summary[k, :4].tolist()) for k in range(1, order + 1)]
    model.singles = (int(summary[1, 0]), int(summary[1, 1]), int(summary[1, 5]))
    return model


def _count_words(rows: DataFrame, root: str, shards: int, flush_tokens: int) -> tuple[list[int], int, int]:
    """Write the vocabulary; (words a shard, tokens, documents)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, documents = [], 0, 0

        def send() -> Iterator[pa.RecordBatch]:
            hashes, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = kit.order_of(hashes)
            hashes, n = hashes[order], n[order]
            edge = _runs(hashes)
            hashes, n = hashes[edge], np.add.reduceat(n, edge)
            yield from _dealt(Vocabulary.shard(hashes, shards), hashes, n)

        for batch in batches:
            for a, b, data, bounds in kit.slices(batch.column(0), 2 << 20):
                hashes = np.sort(tokens(data, bounds)[0])
                edge = _runs(hashes)
                held.append((hashes[edge], np.diff(np.append(edge, len(hashes)))))
                size += len(held[-1][0])
                documents += b - a
                if size > flush_tokens:
                    yield from send()
                    held, size = [], 0
        if held:
            yield from send()
            yield _rows([(-1, _squeeze(np.array([documents])))])

    def write(shard: int, blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        if shard < 0:
            n, total = sum(int(_open(x, 1)[0][0]) for x in blocks), 0
        else:
            hashes, n = (np.concatenate(x) for x in zip(*(_open(x, 2) for x in blocks), strict=True))
            order = kit.order_of(hashes.view(np.uint64))
            hashes, n = hashes.view(np.uint64)[order], n[order]
            edge = _runs(hashes)
            hashes, n = hashes[edge], np.add.reduceat(n, edge)
            kit.put_file(f"{root}/words-{shard}", hashes.astype("<u8").tobytes())
            kit.put_file(f"{root}/counts-{shard}", n.astype("<u8").tobytes())
            n, total = len(hashes), int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([n], pa.int64()), pa.array([total], pa.int64())], ["shard", "n", "total"])

    sent = rows.transform(kit.mapping, count, "shard int, block binary")
    made = {r[0]: (r[1], r[2]) for r in _grouped(sent, write, "shard int, n long, total long").collect()}  # one row a shard
    documents = made.pop(-1, (0, 0))[0]
    sizes = [made.get(s, (0, 0))[0] for s in range(shards)]
    return sizes, sum(x[1] for x in made.values()), documents


def _frequent(spark: SparkSession, root: str, sizes: list[int], documents: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted ids, shares of a shard) of words with at least ``least`` occurrences and of a start that has as many."""
    base = np.concatenate([[0], np.cumsum(sizes)]) + FIRST

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.column(0).to_pylist():
                if not sizes[s]:
                    continue
                counts = kit.map_file(f"{root}/counts-{s}", "<u8", 0, sizes[s]).take(np.arange(sizes[s]))
                at = np.flatnonzero(counts >= least)
                yield pa.RecordBatch.from_arrays([pa.array(at + base[s], pa.int64()), pa.array(counts[at].astype(np.int64))], ["id", "n"])

    got = sorted((r[0], r[1]) for r in spark.range(len(sizes)).transform(kit.mapping, look, "id long, n long").collect())  # at most total / least
    got = [(START, documents)] * (documents >= least) + got
    ids, n = np.array(got, np.int64).reshape(-1, 2).T
    return ids, 1 + n // least


def _count_grams(rows: DataFrame, model: Model, flush_tokens: int) -> DataFrame:
    """Blocks (v, u, w, count) of n-grams by their shard; u is NONE where only the pair counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(model.root, model.vocabulary)
        held, size = [], 0

        def send() -> Iterator[pa.RecordBatch]:
            found, w = kit.distinct(np.concatenate([h for h, _ in held]))
            first = np.concatenate([[0], *(f[1:] + at for (_, f), at in zip(held, np.cumsum([0, *(len(h) for h, _ in held[:-1])]), strict=True))])
            held.clear()
            # words by their number among this task's: small numbers, in the order of the ids
            ids, w = np.concatenate([[START, NONE], words.find(found)[0]]), w + FIRST
            u = _left(w, first, 2) if model.order == 3 else np.full(len(w), NONE, np.int64)
            (v, u, w), n = _collapse([_left(w, first, 1), u, w], None)
            v, u, w = ids[v], ids[u], ids[w]
            yield from _dealt(model.shard(u, v, w), v, u, w, n)

        for batch in batches:
            for _, _, data, bounds in kit.slices(batch.column(0), 2 << 20):
                held.append(tokens(data, bounds))
                size += len(held[-1][0])
                if size > flush_tokens:
                    yield from send()
                    size = 0
        if held:
            yield from send()

    return rows.transform(kit.mapping, count, "shard int, block binary")


def _summary(level: int, values: np.ndarray, more: tuple[int, int] = (0, 0)) -> pa.RecordBatch:
    out = np.zeros((4, 6), "<i8")
    out[level] = [*_of_counts(values), *more]
    return _rows([(-1, _SUMMARY + out.tobytes())])


def _pair_stats(model: Model, v: np.ndarray, w: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What pairs (sorted by v) say of single words, to the words' shards; and their counts of counts."""
    yield _summary(2, value)
    edge = _runs(v)
    right, follow = np.unique(w, return_counts=True)
    ids = np.concatenate([v[edge], right])
    none = np.zeros(len(right), np.int64)
    columns = [np.concatenate([x, none]) for x in _sums(value, edge)] + [np.concatenate([np.zeros(len(edge), np.int64), follow])]
    base = np.concatenate([[0], np.cumsum(model.vocabulary)]) + FIRST
    shard = np.searchsorted(base, ids, "right") - 1  # START: -1
    yield from _dealt(np.where(ids == START, model.shards, shard), ids, *columns, kind=_WORDS)


def _gram_shard(model: Model) -> Callable[[int, list[bytes]], Iterator[pa.RecordBatch]]:
    def finish(shard: int, blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        keys = [np.concatenate(x) for x in zip(*(_open(x, 4) for x in blocks), strict=True)]
        (v, u, w), n = _collapse(keys[:3], keys[3])
        del keys, blocks
        if model.order == 3:
            real = np.flatnonzero(u != NONE)
            v3, u3, n3 = v[real], u[real], n[real]
            kit.put_file(f"{model.root}/grams-{shard}", pack_table(gram(u3, v3, w[real]), n3[:, None]))
            yield _summary(3, n3)
            edge = _runs(v3, u3)
            keys, sums = gram(u3[edge], v3[edge]), _sums(n3, edge)
            to, apart = model.pair_shard(keys, v3[edge])
            whole = np.flatnonzero(~apart)
            kit.put_file(f"{model.root}/contexts-{shard}", pack_table(keys[whole], np.stack(sums, 1)[whole]))
            yield from _dealt(to[apart], keys[apart], *(x[apart] for x in sums), kind=_CONTEXTS)
            del v3, u3, n3, keys, sums, to
        # a pair's value: its different left neighbours, or its occurrences where it is the longest there is
        (v, w), value = _collapse([v, w], np.where(u == NONE, n, 1))
        keys = gram(v, w)
        to, apart = model.pair_shard(keys, v)
        whole = ~apart
        kit.put_file(f"{model.root}/pairs-{shard}", pack_table(keys[whole], value[whole][:, None]))
        yield from _pair_stats(model, v[whole], w[whole], value[whole])
        yield from _dealt(to[apart], v[apart], w[apart], value[apart], kind=_PAIRS)

    return finish


def _merged_shard(model: Model) -> Callable[[int, list[bytes]], Iterator[pa.RecordBatch]]:
    """Contexts and pairs of dealt middle words, from all their shards."""

    def finish(shard: int, blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [_open(x[1:], 5) for x in blocks if x[:1] == _CONTEXTS]
        keys, *sums = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 5
        order = kit.order_of(keys.view(np.uint64))
        keys = keys.view(np.uint64)[order]
        edge = _runs(keys)
        sums = [np.add.reduceat(x[order], edge) if len(edge) else x for x in sums]
        kit.put_file(f"{model.root}/dealt-contexts-{shard}", pack_table(keys[edge], np.stack(sums, 1)))
        parts = [_open(x[1:], 3) for x in blocks if x[:1] == _PAIRS]
        keys = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 3
        (v, w), value = _collapse(keys[:2], keys[2])
        kit.put_file(f"{model.root}/dealt-pairs-{shard}", pack_table(gram(v, w), value[:, None]))
        yield from _pair_stats(model, v, w, value)

    return finish


def _stats_shard(model: Model) -> Callable[[int, list[bytes]], Iterator[pa.RecordBatch]]:
    """Per word: as a context its total and how many words follow once, twice and more often; and how many words it follows."""
    base = np.concatenate([[0], np.cumsum(model.vocabulary)]) + FIRST

    def finish(shard: int, blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        if shard < 0:
            yield _rows([(-1, sum(np.frombuffer(x, "<i8", offset=1) for x in blocks).tobytes())])
            return
        n, low = (model.vocabulary[shard], base[shard]) if shard < model.shards else (1, START)
        table = np.zeros((n, 5), np.int64)
        for block in blocks:
            ids, *columns = _open(block[1:], 5 + 1)
            for k, c in enumerate(columns):
                np.add.at(table[:, k], ids - low, c)
        wide = table.max(initial=0) >= 2**32
        kit.put_file(f"{model.root}/stats-{shard}", np.array([wide], "<u8").tobytes() + table.astype("<u8" if wide else "<u4").tobytes())
        out = np.zeros((4, 6), "<i8")
        out[1] = [*_of_counts(table[:, 4]), int(table[:, 4].sum()), int((table[:, 4] >= 3).sum())]
        yield _rows([(-1, out.tobytes())])

    return finish


# ---------------------------------------------------------------- scoring


class Scorer:
    """The mapped arrays of a model in one worker."""

    def __init__(self, model: Model):
        self.model, self.words = model, Vocabulary(model.root, model.vocabulary)
        self.tables = {name: Tables(model.root, name, n) for name, n in (("grams", 1), ("contexts", 4), ("dealt-contexts", 4), ("pairs", 1), ("dealt-pairs", 1))}
        self.stats = [self._stats_file(s, n) for s, n in enumerate(model.vocabulary)]
        self.start = self._stats_file(model.shards, 1 if model.tokens else 0)

    def _stats_file(self, shard: int, n: int):
        if not n:
            return None
        at = f"{self.model.root}/stats-{shard}"
        wide = kit.map_file(at, "<u8", 0, 1).take([0])[0]
        return kit.map_file(at, "<u8" if wide else "<u4", 8, 5 * n)

    def _stats(self, ids: np.ndarray) -> np.ndarray:
        """(n, 5) statistics of ids; zeros for the unknown."""
        out = np.zeros((len(ids), 5), np.int64)
        known = np.flatnonzero(ids >= FIRST)  # these rise, as the words are sorted
        edge = np.searchsorted(ids[known], self.words.base)
        for s, table in enumerate(self.stats):
            at = known[edge[s] : edge[s + 1]]
            if len(at):
                out[at] = table.take((5 * (ids[at] - self.words.base[s]))[:, None] + np.arange(5))
        if self.start is not None:
            out[ids == START] = self.start.take(np.arange(5))
        return out

    def _pairs(self, kind: str, x: np.ndarray, y: np.ndarray, middle: np.ndarray) -> np.ndarray:
        """Rows of pairs (x, y) or contexts, whichever shards hold them."""
        keys = gram(x, y)
        shard, apart = self.model.pair_shard(keys, middle)
        out = np.zeros((len(keys), self.tables[kind].columns), np.int64)
        out[~apart] = self.tables[kind].find(keys[~apart], shard[~apart], self.model.shards)
        out[apart] = self.tables[f"dealt-{kind}"].find(keys[apart], shard[apart], self.model.shards)
        return out

    @staticmethod
    def _step(count: np.ndarray, context: np.ndarray, d: tuple[float, float, float], shorter: np.ndarray) -> np.ndarray:
        total = np.maximum(context[:, 0], 1)
        seen = _discounted(count, d) / total + (context[:, 1:4] @ np.array(d)) / total * shorter
        return np.where(context[:, 0] > 0, seen, shorter)

    def _each(self, w: np.ndarray, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The probability of every token; ``w`` numbers the different words (from ``FIRST``), ``ids`` are their ids."""
        m, vocabulary = self.model, sum(self.model.vocabulary)
        stats = self._stats(ids)
        rest = float(np.dot(m.discounts[0], m.singles)) / m.bigrams
        alone = _discounted(stats[:, 4], m.discounts[0]) / m.bigrams + rest / (vocabulary + 1)
        # pairs by the numbers of both words
        bits = int(len(ids)).bit_length()
        v = _left(w, first, 1)
        pairs, number = kit.distinct(v.astype(np.uint64) << np.uint64(bits) | w.astype(np.uint64), 2 * bits)
        x, y = (pairs >> np.uint64(bits)).astype(np.int64), (pairs & np.uint64((1 << bits) - 1)).astype(np.int64)
        p = self._step(self._pairs("pairs", ids[x], ids[y], ids[x])[:, 0], stats[x], m.discounts[1], alone[y])[number]
        if m.order == 2:
            return p
        deep = np.ones(len(w), bool)
        deep[first[:-1]] = False  # a first word has a pair alone
        deep = np.flatnonzero(deep)
        # the context of a token is the pair before it
        context = self._pairs("contexts", ids[x], ids[y], ids[y])[number[deep - 1]]
        deep, context = deep[context[:, 0] > 0], context[context[:, 0] > 0]
        by = kit.order_of(y[number[deep - 1]].astype(np.uint64), bits)  # the shard goes by the middle word
        deep, context = deep[by], context[by]
        at = number[deep - 1]
        u, v, w = ids[x[at]], ids[y[at]], ids[w[deep]]
        count = self.tables["grams"].find(gram(u, v, w), m.shard(u, v, w), m.shards)[:, 0]
        p[deep] = self._step(count, context, m.discounts[2], p[deep])
        return p

    def score(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per document: tokens, known tokens, base score, score."""
        m = self.model
        hashes, first = tokens(data, bounds)
        found, number = kit.distinct(hashes)
        ids, counts = self.words.find(found)
        base = np.log10((counts + 1.0) / (m.tokens + sum(m.vocabulary) + 1.0))[number]
        each = np.log10(self._each(number + FIRST, np.concatenate([[START, NONE], ids]), first)) if m.tokens else np.zeros(len(hashes))
        at = first[:-1]
        return np.diff(first), np.add.reduceat((counts > 0).astype(np.int64)[number], at), np.add.reduceat(base, at), np.add.reduceat(each, at)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for a, b, data, bounds in kit.slices(batch.column(1), 8 << 20):
                n, known, base, total = scorer.score(data, bounds)
                cols = [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(b - a, model.tokens), pa.int64()), pa.array(base), pa.array(total), pa.array(10.0 ** (-total / n))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *cols], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return rows.transform(kit.mapping, label, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
