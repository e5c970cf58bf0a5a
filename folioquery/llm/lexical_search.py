"""Ranked lexical search by sort-based accumulation.

Terms are maximal runs of ASCII letters, digits and characters above 0x7F, A-Z lower-cased. One pass over the documents counts N, L
and the document frequency of every term that some item asks for; a second pass scores. There a slice of documents finds its
matched (document, term) pairs, expands each into an (item, document, impact) entry for every item that holds the term, sorts the packed
(item, document) keys by a radix sort over 16-bit digits and sums impacts with ``reduceat``; so no accumulator is kept for documents, and memory depends on the
slice alone. A heap an item keeps the best ``k`` of a task. What tasks found is range-partitioned by item, and heaps select again.

The items are the stated query set: (item, term) rows are written to the shared folder in blocks of ``BLOCK_ROWS`` as sorted arrays,
which workers map and go through block by block; nothing is broadcast, and each document is read once a pass however many blocks there are.
A task that holds more than ``KEPT_ROWS`` entries in its heaps hands them on and starts anew.

A term stands for its text by a 64-bit hash. Defined cases: a null text has no terms, so an item without text or with unknown terms alone gets no rows;
every row of ``docs`` is a document, repeated rows and null ids included (a null doc_id comes after all others of its score); rows that
share an item_id, null included, are one item with the terms of all; empty tables give no rows. Other columns of either table are not read.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit

#: (item, term) rows of a block file.
BLOCK_ROWS = 1 << 19
#: Entries that the heaps of a task hold at most.
KEPT_ROWS = 1 << 19
_NULL = np.int64(-(2**63))
_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FOUND = "item_id long, doc_id long, score long"


def radix_order(keys: np.ndarray, most: int) -> np.ndarray:
    """What sorts unsigned keys of at most ``most``: stable passes over 16-bit digits, the lowest first."""
    order = np.argsort((keys & np.uint64(0xFFFF)).astype(np.uint16), kind="stable")
    shift = 16
    while most >> shift:
        digit = ((keys >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
        order = order[np.argsort(digit[order], kind="stable")]
        shift += 16
    return order


def sums_by_key(keys: np.ndarray, most: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of each one's values."""
    if not len(keys):
        return keys, values
    order = radix_order(keys, most)
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(values[order], first)


def term_hashes(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document number, term hash) arrays of a slice. A long document comes in stripes that are cut between terms."""
    at = 0
    while at < len(data):
        stop = len(data)
        if stop - at > 2 * kit.SLICE_BYTES:
            stop = at + kit.SLICE_BYTES
            while stop < len(data):  # on to the next separator
                gap = np.flatnonzero(~_TERM[data[stop : stop + kit.SLICE_BYTES]])
                stop += int(gap[0]) if len(gap) else min(kit.SLICE_BYTES, len(data) - stop)
                if len(gap):
                    break
        part = data[at:stop]
        solid = _TERM[part]
        cut = np.zeros(len(part) + 1, bool)
        cut[0] = cut[-1] = True
        cut[bounds[(bounds >= at) & (bounds <= stop)] - at] = True
        start = np.flatnonzero(solid & (cut[:-1] | np.r_[True, ~solid[:-1]]))
        end = np.flatnonzero(solid & (cut[1:] | np.r_[~solid[1:], True])) + 1
        yield np.searchsorted(bounds, start + at, "right") - 1, kit.string_hashes(_LOWER[part], start, end).view(np.int64)
        at = stop


class Block:
    """A block file: sorted term hashes, and for each the items that hold it, with the term's weight."""

    def __init__(self, uri: str):
        head = self._array(uri, 0, 3)
        terms, rows, items = (int(x) for x in head)
        sizes = [terms, terms + 1, terms, rows, items]
        at = 24 + 8 * np.cumsum([0, *sizes])
        self.hashes, self.first, self.weights, self.items, self.ids = (self._array(uri, int(a), n) for a, n in zip(at, sizes, strict=False))

    @staticmethod
    def _array(uri: str, at: int, count: int) -> np.ndarray:
        got = kit.map_file(uri, "<i8", at, count)
        return got.take(np.arange(count)) if isinstance(got, kit.Paged) else got

    @staticmethod
    def content(item: np.ndarray, term: np.ndarray, weight: np.ndarray) -> bytes:
        order = np.lexsort((item, term))
        item, term, weight = item[order], term[order], weight[order]
        first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
        ids, number = np.unique(item, return_inverse=True)
        parts = [[len(first), len(term), len(ids)], term[first], [*first, len(term)], weight[first], number, ids]
        return b"".join(np.asarray(p, "<i8").tobytes() for p in parts)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose hash is in the block, and the term's number."""
        if not len(self.hashes) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        rows = np.flatnonzero(self.hashes[at] == hashes)
        return rows, at[rows]


def _write_blocks(df: DataFrame, name: str, key: str) -> list[str]:
    """Write rows (item, term, weight) as block files, all rows of a ``key`` in one; returns their names."""
    root = f"{kit.shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            uri = f"{root}/{uuid.uuid4().hex}"
            kit.put_file(uri, Block.content(*(kit.ints(t[c], int(_NULL)) for c in ("item", "term", "weight"))))
            yield pa.record_batch([pa.array([uri])], ["uri"])

    count = df.count()
    dealt = df.repartition(-(-count // BLOCK_ROWS), key) if count else df.coalesce(1)
    uris = dealt.select("item", "term", "weight").transform(kit.mapping, work, "uri string")
    return sorted(r.uri for r in kit.written(uris, f"{name}-names").collect())  # a name for half a million rows; of a task that ran twice, one


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term hash) rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, null = kit.ints(b.column("item_id"), 0), b.column("item_id").is_null().to_numpy(False)
            for row, _, data, bounds in kit.slices(b.column("text")):
                for doc, term in term_hashes(data, bounds):
                    at = doc + row
                    yield pa.record_batch([pa.array(ids[at], pa.int64(), mask=null[at]), pa.array(term)], ["item_id", "term"])

    read = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    return read.transform(kit.mapping, work, "item_id long, term long").distinct()


def corpus_counts(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(kind, term, n): kind 0 counts the documents with a term, 1 all terms, 2 the documents that hold each term of the vocabulary."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [Block(u) for u in vocabulary]
        held = [np.zeros(len(b.hashes), np.int64) for b in blocks]
        total, length = 0, 0
        for batch in batches:
            for row, stop, data, bounds in kit.slices(batch.column("text")):
                size = np.zeros(stop - row, np.int64)
                seen: list[list[np.ndarray]] = [[] for _ in blocks]
                for doc, term in term_hashes(data, bounds):
                    size += np.bincount(doc, minlength=len(size))
                    for b, found in zip(blocks, seen, strict=True):
                        at, number = b.find(term)
                        found.append(np.unique(doc[at] * len(b.hashes) + number))
                total, length = total + int((size > 0).sum()), length + int(size.sum())
                for b, n, found in zip(blocks, held, seen, strict=True):
                    if found and len(b.hashes):
                        n += np.bincount(np.unique(np.concatenate(found)) % len(b.hashes), minlength=len(n))
        kinds, terms, counts = [np.array([0, 1])], [np.zeros(2, np.int64)], [np.array([total, length])]
        for b, n in zip(blocks, held, strict=True):
            at = np.flatnonzero(n)
            kinds.append(np.full(len(at), 2)), terms.append(b.hashes[at]), counts.append(n[at])
        yield pa.record_batch([pa.array(np.concatenate(x)) for x in (kinds, terms, counts)], ["kind", "term", "n"])

    read = docs.select(F.col("text").cast("string"))
    return read.transform(kit.mapping, work, "kind long, term long, n long").groupBy("kind", "term").agg(F.sum("n").alias("n"))


def lengths(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """100 - 90 + ((90 * n * N) div L), by wide integers where 64 bits would not do."""
    if 90 * documents * int(n.max(initial=0)) < 2**63:
        return 10 + 90 * n * documents // total
    return np.array([10 + 90 * int(x) * documents // total for x in n], np.int64)


class Heaps:
    """The best k documents of each item so far."""

    def __init__(self, k: int):
        self.k, self.held, self.entries = k, {}, 0

    def offer(self, item: int | None, score: int, doc: int | None) -> None:
        heap = self.held.setdefault(item, [])
        entry = (score, doc is not None, -doc if doc is not None else 0)
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
            self.entries += 1
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)

    def least(self, item: int | None) -> int:
        """A score below this cannot enter."""
        heap = self.held.get(item, ())
        return heap[0][0] if len(heap) == self.k else 1

    def rows(self) -> Iterator[tuple[int | None, int | None, int, int]]:
        """(item, document, score, rank) of all items; the heaps are empty afterwards."""
        for item, heap in self.held.items():
            for rank, (score, known, doc) in enumerate(sorted(heap, reverse=True), 1):
                yield item, -doc if known else None, score, rank
        self.held, self.entries = {}, 0


def _batches(heaps: Heaps, columns: int) -> Iterator[pa.RecordBatch]:
    names = ["item_id", "doc_id", "score", "rank"][:columns]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32()][:columns]
    rows = list(heaps.rows())
    for at in range(0, len(rows), 1 << 16):
        part = list(zip(*rows[at : at + (1 << 16)], strict=True))[:columns]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(part, kinds, strict=True)], names)


def partial_ranking(docs: DataFrame, blocks: list[str], documents: int, total: int, k: int) -> DataFrame:
    """(item_id, doc_id, score): the best k of each task for every item."""

    def score(block: Block, doc: np.ndarray, number: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item number, document number and score of every matched pair in the slice."""
        terms = len(block.hashes)
        pair, tf = sums_by_key((doc * terms + number).astype(np.uint64), len(m) * terms, np.ones(len(doc), np.int64))
        doc, number = (x.astype(np.int64) for x in np.divmod(pair, np.uint64(terms)))
        impact = block.weights[number] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        start, many = block.first[number], block.first[number + 1] - block.first[number]
        item = block.items[kit.ragged(start, many)]
        key = item.astype(np.uint64) * np.uint64(len(m)) + np.repeat(doc, many).astype(np.uint64)
        key, sums = sums_by_key(key, len(block.ids) * len(m), np.repeat(impact, many))
        item, doc = np.divmod(key, np.uint64(len(m)))
        return item.astype(np.int64), doc.astype(np.int64), sums

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Block(u) for u in blocks]
        heaps = Heaps(k)
        floors = [np.ones(len(b.ids), np.int64) for b in held]
        for batch in batches:
            ids = kit.ints(batch.column("doc_id"), int(_NULL))
            for row, stop, data, bounds in kit.slices(batch.column("text")):
                size = np.zeros(stop - row, np.int64)
                found: list[list[tuple]] = [[] for _ in held]
                for doc, term in term_hashes(data, bounds):
                    size += np.bincount(doc, minlength=len(size))
                    for b, got in zip(held, found, strict=True):
                        at, number = b.find(term)
                        got.append((doc[at], number))
                m = lengths(size, documents, total)
                for b, got, floor in zip(held, found, floors, strict=True):
                    doc, number = (np.concatenate([g[i] for g in got]) if got else np.zeros(0, np.int64) for i in (0, 1))
                    if not len(doc):
                        continue
                    item, doc, scores = score(b, doc, number, m)
                    at = np.flatnonzero(scores >= floor[item])
                    for i, d, s in zip(item[at].tolist(), ids[row + doc[at]].tolist(), scores[at].tolist(), strict=True):
                        if s >= floor[i]:
                            name = None if b.ids[i] == _NULL else int(b.ids[i])
                            heaps.offer(name, s, None if d == _NULL else d)
                            floor[i] = heaps.least(name)
                if heaps.entries > KEPT_ROWS:
                    yield from _batches(heaps, 3)
                    for floor in floors:
                        floor[:] = 1
        yield from _batches(heaps, 3)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(kit.mapping, work, _FOUND)


def select_best(found: DataFrame, k: int, ranked: bool) -> DataFrame:
    """The best k rows of every item within a partition; with their rank where a partition holds all of an item's rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(k)
        for b in batches:
            for item, doc, score in zip(*(b.column(c).to_pylist() for c in ("item_id", "doc_id", "score")), strict=True):
                heaps.offer(item, score, doc)
            if not ranked and heaps.entries > KEPT_ROWS:
                yield from _batches(heaps, 3)
        yield from _batches(heaps, 4 if ranked else 3)

    return found.transform(kit.mapping, work, _FOUND + (", rank int" if ranked else ""))


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k documents of the highest score above 0; equal scores by doc_id."""
    spark = docs.sparkSession
    kit.bound_batches(spark)
    wanted = kit.written(item_terms(items), "search-terms")
    words = wanted.select("term").distinct().select(F.lit(0).cast("long").alias("item"), "term", F.lit(0).cast("long").alias("weight"))
    counts = kit.written(corpus_counts(docs, _write_blocks(words, "search-vocabulary", "term")), "search-counts")
    totals = {r.kind: r.n for r in counts.where("kind < 2").collect()}
    n = totals.get(0, 0)
    weight = F.floor(1000 * F.log((2 * F.lit(n).cast("double") + 2) / (2 * F.col("n") + 1))).cast("long")
    weighed = wanted.join(counts.where("kind = 2").select("term", "n"), "term")
    blocks = _write_blocks(weighed.select(F.col("item_id").alias("item"), "term", weight.alias("weight")), "search-blocks", "item")
    if not blocks:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = kit.written(partial_ranking(docs, blocks, n, totals[1], k), "search-found")
    best = kit.written(select_best(found, k, False), "search-best")
    dealt = best.repartitionByRange(kit.partitions(spark), "item_id")
    return select_best(dealt, k, True).select("item_id", "rank", "doc_id", "score")
