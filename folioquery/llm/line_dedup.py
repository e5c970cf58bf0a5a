"""Line dedup with a sharded minimal perfect hash.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased; keys of at least
``min_chars`` code points count. Each map task sends every distinct key's 128-bit hash once to its
shard, with the number of documents and the largest doc_id (so a line that a third of all documents
share sends one record a task). A shard builds a minimal perfect hash over its distinct hashes; counts
and largest ids accumulate in arrays that it indexes. Keys in at least ``min_docs`` documents are served: as many serving shards as their
measured size asks for, each a file in the shared folder with a second such hash and the arrays that it indexes: fingerprints, counts and
largest ids.

Documents probe the serving arrays instead of joining lines: workers map the files, so a look-up reads the pages that it touches and neither
texts nor arrays are shuffled or broadcast, whatever their size.

A key stands for its line by 128 bits of two independent hashes: two of n lines share them with a chance of about n * n / 2**129.

Defined cases: a null or empty text is one empty line, and stays as it is; every row is a document, so
repeated rows count each; a null doc_id ranks below all others; in the largest doc_id holding a key all
its lines stay. Other input columns are carried through unchanged.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit

_NONE = np.int64(-(2**63))
_RECORD = np.dtype([("a", "<u8"), ("b", "<u8"), ("docs", "<i8"), ("last", "<i8")])
#: Bytes of a served key: fingerprint, count, id and its share of the perfect hash.
_SERVED = 33


class PerfectHash:
    """A minimal perfect hash: levels of bit arrays; a key that shares its bit with another tries the next level.

    The rank of a key's bit over all levels is its place, 0 .. n-1. Keys outside the set get some place
    or -1, so callers compare fingerprints.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, base = [], 0
        for bits in levels:
            self.ranks.append(np.cumsum(bits, dtype=np.int64) - 1 + base)
            base += int(bits.sum())
        self.n = base

    @staticmethod
    def place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (kit.mix(a + b * np.uint64(2 * level + 1)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray, load: float = 2.0) -> PerfectHash:
        """Over distinct (a, b)."""
        levels: list[np.ndarray] = []
        while len(a):
            size = max(8, int(load * len(a)))
            at = cls.place(a, b, len(levels), size)
            hits = np.bincount(at, minlength=size)
            levels.append(hits == 1)
            left = hits[at] > 1
            a, b = a[left], b[left]
        return cls(levels)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), -1, np.int64)
        left = np.arange(len(a))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(left):
                break
            at = self.place(a[left], b[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return out

    def words(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Each level's bits in 64-bit words, and how many bits of all levels precede each word."""
        words, before, total = [], [], 0
        for bits in self.levels:
            padded = np.zeros(-(-len(bits) // 64) * 64, bool)
            padded[: len(bits)] = bits
            words.append(np.packbits(padded, bitorder="little").view("<u8"))
            many = np.bitwise_count(words[-1]).astype(np.int64)
            before.append(np.cumsum(many) - many + total)
            total += int(many.sum())
        return words, before


class Lines:
    """Lines of a run of documents: bounds, and for keys of enough code points their 128-bit hashes."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, min_chars: int):
        words = kit.Words(data, bounds, lower=True)
        feed = np.flatnonzero(data == 0x0A)
        owner = np.searchsorted(bounds, feed, "right") - 1
        n = len(bounds) - 1
        #: Lines of each document: one more than its line feeds.
        self.counts = np.bincount(owner, minlength=n) + 1
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        start = np.empty(self.first[-1], np.int64)
        end = np.empty(self.first[-1], np.int64)
        inner = np.ones(len(start), bool)
        inner[self.first[:-1]] = False
        start[self.first[:-1]] = bounds[:-1]
        start[inner] = feed + 1
        inner = np.ones(len(start), bool)
        inner[self.first[1:] - 1] = False
        end[self.first[1:] - 1] = bounds[1:]
        end[inner] = feed
        self.start, self.end = start, end
        low, high = np.searchsorted(words.start, start), np.searchsorted(words.start, end)
        solid = np.flatnonzero(high > low)
        s, e = words.start[low[solid]], words.end[high[solid] - 1]
        points = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
        long = points[e] - points[s] >= min_chars
        #: Numbers of the lines with a key that counts, and the key's two hashes.
        self.keyed, s, e = solid[long], s[long], e[long]
        self.a, self.b = kit.string_hashes(words.data, s, e), kit.string_hashes(words.data, s, e, kit._BASE2)
        self.doc = np.searchsorted(self.first, self.keyed, "right") - 1


def _merge(records: np.ndarray) -> np.ndarray:
    """One record per (a, b): documents add up, the largest id stays."""
    order = np.lexsort((records["b"], records["a"]))
    records = records[order]
    if not len(records):
        return records
    edge = np.flatnonzero(np.r_[True, (records["a"][1:] != records["a"][:-1]) | (records["b"][1:] != records["b"][:-1])])
    out = records[edge]
    out["docs"] = np.add.reduceat(records["docs"], edge)
    out["last"] = np.maximum.reduceat(records["last"], edge)
    return out


def _by_shard(records: np.ndarray, shards: int) -> Iterator[tuple[int, bytes]]:
    squeeze = zstandard.ZstdCompressor(level=1)
    shard = (records["a"] % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    records, shard = records[order], shard[order]
    cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else []
    for i, j in zip(cut, np.append(cut[1:], len(shard)), strict=True):
        part = records[i:j]  # column by column: ids and counts then compress well
        yield int(shard[i]), squeeze.compress(b"".join(np.ascontiguousarray(part[f]).tobytes() for f in part.dtype.names))


def _records(block: bytes, dtype: np.dtype) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(block)
    n = len(raw) // dtype.itemsize
    out = np.empty(n, dtype)
    for k, f in enumerate(dtype.names):
        out[f] = np.frombuffer(raw, dtype[f], n, 8 * n * k)
    return out


def _shard_rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), kit.binaries([r[1] for r in rows])], ["shard", "block"])


COUNTED = "keys long, served long, block binary"


def count_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, flush_lines: int = 1_500_000) -> DataFrame:
    """A row for each shard of keys: how many distinct keys it has, how many are in at least ``min_docs`` documents, and the records of those."""
    shards = 2 * kit.partitions(docs.sparkSession)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids = kit.ints(batch.column(0), _NONE)
            for a, b, data, bounds in kit.slices(batch.column(1)):
                lines = Lines(data, bounds, min_chars)
                # once a document
                order = np.lexsort((lines.b, lines.a, lines.doc))
                d, x, y = lines.doc[order], lines.a[order], lines.b[order]
                new = np.r_[True, (d[1:] != d[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])][: len(d)]
                record = np.empty(int(new.sum()), _RECORD)
                record["a"], record["b"], record["docs"], record["last"] = x[new], y[new], 1, ids[a:b][d[new]]
                held.append(record)
                size += len(record)
                if size > flush_lines:
                    yield _shard_rows(list(_by_shard(_merge(np.concatenate(held)), shards)))
                    held, size = [], 0
        if size:
            yield _shard_rows(list(_by_shard(_merge(np.concatenate(held)), shards)))

    def index(shard: int, blocks: list[bytes]) -> pa.RecordBatch:
        records = np.concatenate([_records(x, _RECORD) for x in blocks])
        order = np.lexsort((records["b"], records["a"]))
        a, b = records["a"][order], records["b"][order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
        a, b = a[new], b[new]
        places = PerfectHash.build(a, b)
        at = places(records["a"], records["b"])
        counts, last, mine = np.zeros(places.n, np.int64), np.full(places.n, _NONE), places(a, b)
        np.add.at(counts, at, records["docs"])
        np.maximum.at(last, at, records["last"])
        many = counts[mine] >= min_docs
        served = np.empty(int(many.sum()), _RECORD)
        served["a"], served["b"], served["docs"], served["last"] = a[many], b[many], counts[mine[many]], last[mine[many]]
        return pa.RecordBatch.from_arrays([pa.array([len(mine)], pa.int64()), pa.array([len(served)], pa.int64()), kit.binaries([served.tobytes()])], ["keys", "served", "block"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, now = [], None
        for batch in batches:
            for shard, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if shard != now:
                    if blocks:
                        yield index(now, blocks)
                    blocks, now = [], shard
                blocks.append(block)
        if blocks:
            yield index(now, blocks)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = rows.transform(kit.mapping, split, "shard int, block binary")
    return sent.repartition("shard").sortWithinPartitions("shard").transform(kit.mapping, gather, COUNTED)


@dataclass(frozen=True)
class Index:
    """Serving shards as files, and how many keys each serves."""

    root: str
    sizes: tuple[int, ...]

    def shard(self, a: np.ndarray) -> np.ndarray:
        return (kit.mix(a) % np.uint64(max(1, len(self.sizes)))).astype(np.int64)


def build_index(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, shard_bytes: int = 64 << 20, **limits: int) -> Index:
    """Count all lines and write the serving shards, each of about ``shard_bytes``; the driver gets their sizes alone."""
    spark = docs.sparkSession
    root = f"{kit.shared_dir(spark)}/line-index-{uuid.uuid4().hex}"
    counted = kit.written(count_lines(docs, min_chars, min_docs, **limits), "line-counts")
    total = counted.agg(F.sum("served")).first()[0] or 0
    index = Index(root, (0,) * max(1, -(-total * _SERVED // shard_bytes)))
    many = len(index.sizes)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                records = np.frombuffer(raw, _RECORD)
                shard = index.shard(records["a"])
                order = np.argsort(shard, kind="stable")
                edge = np.searchsorted(shard[order], np.arange(many + 1))
                rows = [(s, records[order[edge[s] : edge[s + 1]]].tobytes()) for s in np.flatnonzero(np.diff(edge)).tolist()]
                if rows:
                    yield _shard_rows(rows)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for shard, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if shard not in held:  # the shards come one after the other
                    yield from finish(held)
                held.setdefault(shard, []).append(block)
        yield from finish(held)

    def finish(held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        while held:
            shard, blocks = held.popitem()
            records = np.frombuffer(b"".join(blocks), _RECORD)
            kit.put_file(f"{root}/serve-{shard}", _serving_file(records))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(records)], pa.int64())], ["shard", "n"])

    sent = counted.where("served > 0").select("block").transform(kit.mapping, deal, "shard int, block binary")
    made = sent.repartition("shard").sortWithinPartitions("shard").transform(kit.mapping, write, "shard int, n long")
    sizes = dict(map(tuple, made.collect()))  # a short row a shard
    return Index(root, tuple(sizes.get(s, 0) for s in range(many)))


def _serving_file(records: np.ndarray) -> bytes:
    """Head (keys, levels, words), the levels' sizes, bits and ranks, then the arrays by place."""
    places = PerfectHash.build(records["a"], records["b"])
    at = places(records["a"], records["b"])
    words, before = places.words()
    prints, counts, last = np.empty((len(records), 2), "<u8"), np.empty(len(records), "<i8"), np.empty(len(records), "<i8")
    prints[at, 0], prints[at, 1], counts[at], last[at] = records["a"], records["b"], records["docs"], records["last"]
    head = np.array([len(records), len(words), sum(map(len, words)), *(len(x) for x in places.levels)], "<i8")
    flat = [np.concatenate([*x, np.zeros(0, "<u8")]).astype("<u8").tobytes() for x in (words, before)]
    return b"".join([head.tobytes(), *flat, prints.tobytes(), counts.tobytes(), last.tobytes()])


class Shard:
    """The mapped serving arrays of one shard."""

    def __init__(self, index: Index, shard: int):
        uri = f"{index.root}/serve-{shard}"
        n, levels, words = kit.map_file(uri, "<i8", 0, 3).take(np.arange(3)).tolist()
        self.sizes = kit.map_file(uri, "<i8", 24, levels).take(np.arange(levels)).tolist()
        at = 24 + 8 * levels
        arrays = []
        for dtype, count in (("<u8", words), ("<u8", words), ("<u8", 2 * n), ("<i8", n), ("<i8", n)):
            arrays.append(kit.map_file(uri, dtype, at, count))
            at += 8 * count
        self.bits, self.before, self.prints, self.counts, self.last = arrays

    def place(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The keys' places, or -1; a key that is not served may get some place."""
        out, left, first = np.full(len(a), -1, np.int64), np.arange(len(a)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = PerfectHash.place(a[left], b[left], level, size)
            word, bit = first + (at >> 6), (at & 63).astype(np.uint64)
            bits = self.bits.take(word)
            hit = np.flatnonzero(bits >> bit & np.uint64(1))
            below = bits[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.before.take(word[hit]).astype(np.int64) + np.bitwise_count(below)
            left = np.delete(left, hit)
            first += -(-size // 64)
        return out

    def last_of(self, a: np.ndarray, b: np.ndarray, min_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """(the largest id of each key, which keys are served)."""
        at = self.place(a, b)
        known = np.flatnonzero(at >= 0)
        place = at[known]
        same = (self.prints.take(2 * place) == a[known]) & (self.prints.take(2 * place + 1) == b[known])
        known, place = known[same], place[same]
        known, place = known[self.counts.take(place) >= min_docs], place[self.counts.take(place) >= min_docs]
        out, served = np.full(len(a), _NONE), np.zeros(len(a), bool)
        out[known], served[known] = self.last.take(place), True
        return out, served


def _apply(batch: pa.RecordBatch, drop_of, min_chars: int, text_at: int) -> pa.RecordBatch:
    """Append n_lines, n_dropped, kept_text; drop_of(rows a..b, lines) marks the keyed lines to drop."""
    n_lines, n_dropped, kept = [], [], []
    for a, b, data, bounds in kit.slices(batch.column(text_at)):
        lines = Lines(data, bounds, min_chars)
        gone = np.zeros(len(lines.start), bool)
        gone[lines.keyed[drop_of(a, b, lines)]] = True
        n_lines.append(lines.counts)
        lost = np.add.reduceat(gone.astype(np.int64), lines.first[:-1]) if b > a else np.zeros(0, np.int64)
        n_dropped.append(lost)
        raw = data.tobytes()
        for k in range(b - a):
            if not lost[k]:
                kept.append(raw[bounds[k] : bounds[k + 1]])
                continue
            rows = np.arange(lines.first[k], lines.first[k + 1])[~gone[lines.first[k] : lines.first[k + 1]]]
            kept.append(b"\n".join([raw[s:e] for s, e in zip(lines.start[rows].tolist(), lines.end[rows].tolist(), strict=True)]))
    flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    more = [pa.array(flat(n_lines), pa.int64()), pa.array(flat(n_dropped), pa.int64()), kit.binaries(kept).cast(pa.string())]
    return pa.RecordBatch.from_arrays([*batch.columns, *more], [str(i) for i in range(batch.num_columns + 3)])


def drop_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, shard_bytes: int = 64 << 20) -> DataFrame:
    """All columns of ``docs``, then ``n_lines`` (before dropping), ``n_dropped`` and ``kept_text``.

    Input columns of these names come first, unchanged; select by position where names clash.
    """
    kit.bound_batches(docs.sparkSession)
    index = build_index(docs, min_chars, min_docs, shard_bytes)
    many = len(index.sizes)
    # names inside: positions, so that no input name can clash
    names = [f"c{i}" for i in range(len(docs.columns))]
    where = {c.lower(): i for i, c in reversed(list(enumerate(docs.columns)))}
    doc_at, text_at = where["doc_id"], where["text"]
    inside = docs.toDF(*names)
    inside = inside.select(*inside.columns, F.col(names[doc_at]).cast("long").alias("__id"))
    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True))
    n = len(names)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, Shard] = {}
        for batch in batches:
            ids = kit.ints(batch.column(n), _NONE)

            def drop_of(a: int, b: int, lines: Lines) -> np.ndarray:
                gone = np.zeros(len(lines.a), bool)
                shard = index.shard(lines.a)
                order = np.argsort(shard, kind="stable")
                edge = np.searchsorted(shard[order], np.arange(many + 1))
                for s in np.flatnonzero(np.diff(edge)).tolist():
                    if index.sizes[s]:
                        if s not in tables:
                            tables[s] = Shard(index, s)
                        at = order[edge[s] : edge[s + 1]]
                        last, known = tables[s].last_of(lines.a[at], lines.b[at], min_docs)
                        gone[at] = known & (last != ids[a:b][lines.doc[at]])  # noqa: B023
                return gone

            out = _apply(batch, drop_of, min_chars, text_at)
            yield pa.RecordBatch.from_arrays([*out.columns[:n], *out.columns[n + 1 :]], [*names, "__n_lines", "__n_dropped", "__kept"])

    done = inside.transform(kit.mapping, probe, f"{kinds}, __n_lines long, __n_dropped long, __kept string")
    return done.toDF(*docs.columns, "n_lines", "n_dropped", "kept_text")
