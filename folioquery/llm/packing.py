"""Best-fit packing of token sequences.

The global best-fit-decreasing result depends only on how many pieces there are of each length, so
the driver holds one counter per length (at most ``capacity``), never pieces. A segment tree over
remaining capacities finds the tightest open bin for a length in O(log capacity); bins of equal
remaining capacity are kept as ranges, so a placement covers whole runs of pieces. Pieces then look
up their bin by (length, rank), where ranks come from per-bucket counts: no single task sees all
pieces of a frequent length.

Defined cases: a null or empty text is the end id alone; a null doc_id is carried through; repeated
rows are separate documents; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kit

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Code points below this limit are stable under NFC and lower-case one to one (but for U+0130).
_PLAIN = 0x250


class SegmentTree:
    """Which remaining capacities have open bins; leftmost set position at or after a given one."""

    def __init__(self, size: int):
        self.size = 1 << max(1, size.bit_length())
        self.any = np.zeros(2 * self.size, bool)

    def set(self, at: int, value: bool) -> None:
        i = at + self.size
        self.any[i] = value
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def first_from(self, at: int) -> int:
        """The smallest set position >= at, or -1."""
        i = at + self.size
        if self.any[i]:
            return at
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over a histogram of lengths.

    Returns placements (length, first rank, first bin, pieces per bin, offset) sorted by (length,
    rank), and the number of bins. The piece of rank r >= first rank goes to bin
    first bin + (r - first rank) // per_bin at offset + (r - first rank) % per_bin * length.
    """
    tree, open_bins, out, bins = SegmentTree(capacity + 1), defaultdict(deque), [], 0

    def put(left: int, first: int, n: int) -> None:
        if n and left:
            open_bins[left].append((first, n))
            tree.set(left, True)

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            left = tree.first_from(length)
            if left < 0:
                left, (first, n) = capacity, (bins, -(-todo // (capacity // length)))
                bins += n
            else:
                first, n = open_bins[left].popleft()
                if not open_bins[left]:
                    tree.set(left, False)
            per = left // length
            full = min(n, todo // per)
            if full:
                out.append((length, rank, first, per, capacity - left))
                put(left - per * length, first, full)
                rank, todo = rank + full * per, todo - full * per
            first, n = first + full, n - full
            if n and todo and todo < per:
                out.append((length, rank, first, per, capacity - left))
                put(left - todo * length, first, 1)
                rank, todo, first, n = rank + todo, 0, first + 1, n - 1
            put(left, first, n)
    return sorted(out), bins


class WordPieces:
    """Token ids of whole texts; pre-tokens are encoded once each and then gathered from a cache.

    The cache goes by hash, and every pre-token is compared with the one that was encoded: where a hash stands for two, the run goes
    through the tokenizer itself. Texts outside the plain range, or holding apostrophes or special-token markers, go through
    the tokenizer itself.
    """

    def __init__(self, path: str, cache: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cache = Tokenizer.from_file(path), cache
        kinds = np.zeros(_PLAIN, np.uint8)  # 0 space, 1 letter, 2 number, 3 other
        for c in range(_PLAIN):
            kind = unicodedata.category(chr(c))[0]
            kinds[c] = 0 if c in (0x20, 0x85, 0xA0) or 9 <= c <= 13 else {"L": 1, "N": 2}.get(kind, 3)
        self.kinds = kinds
        self.reset()

    def reset(self) -> None:
        self.keys, self.at, self.size, self.of, self.length = np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4))
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.pieces, self.end = np.zeros(1 << 16, np.uint16), 0

    def _ids(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each piece) of pieces of ``codes``: encoded as one text, a space after each."""
        end = np.cumsum(size + 1)
        joined = np.full(int(end[-1]), 0x20, np.uint16)
        joined[kit.ragged(end - size - 1, size)] = codes[kit.ragged(start, size)]
        text = joined.tobytes().decode("utf-16-le")
        got = self.tokenizer.encode(text, add_special_tokens=False)
        counts = np.bincount(np.array(got.word_ids, np.int64), minlength=len(size))
        if len(counts) == len(size):
            return np.array(got.ids, np.uint32), counts
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(text.split(" ")[:-1], add_special_tokens=False)]
        return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids])

    def _learn(self, keys: np.ndarray, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        if len(self.keys) + len(keys) > self.cache:
            raise OverflowError
        parts = [self._ids(codes, start[k : k + 2000], size[k : k + 2000]) for k in range(0, len(keys), 2000)]
        new, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        spelled = codes[kit.ragged(start, size)]
        self.flat, self.pieces = self._room(self.flat, self.used, len(new)), self._room(self.pieces, self.end, len(spelled))
        self.flat[self.used : self.used + len(new)], self.pieces[self.end : self.end + len(spelled)] = new, spelled
        more = keys, np.cumsum(n) - n + self.used, n, np.cumsum(size) - size + self.end, size
        self.used, self.end = self.used + len(new), self.end + len(spelled)
        merged = [np.concatenate(x) for x in zip((self.keys, self.at, self.size, self.of, self.length), more, strict=True)]
        order = np.argsort(merged[0], kind="stable")
        self.keys, self.at, self.size, self.of, self.length = (x[order] for x in merged)

    @staticmethod
    def _room(held: np.ndarray, used: int, more: int) -> np.ndarray:
        return held if used + more <= len(held) else np.concatenate([held[:used], np.zeros(max(used, 2 * more), held.dtype)])

    def _plain(self, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of all texts and where each begins; None where a hash stands for two pre-tokens."""
        kind = self.kinds[codes]
        cut = np.zeros(len(codes) + 1, bool)
        cut[bounds] = True
        cut[1:-1] |= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        edge = np.flatnonzero(cut)
        start, end = edge[:-1], edge[1:]
        solid = kind[start] > 0
        start, end = start[solid], end[solid]
        found, first, back = np.unique(kit.string_hashes(codes.view(np.uint8), 2 * start, 2 * end), return_index=True, return_inverse=True)
        while True:
            where = np.searchsorted(self.keys, found)
            known = np.zeros(len(found), bool)
            inside = where < len(self.keys)
            known[inside] = self.keys[where[inside]] == found[inside]
            if known.all():
                break
            new = np.flatnonzero(~known)
            try:
                self._learn(found[new], codes, start[first[new]], (end - start)[first[new]])
            except OverflowError:
                if not len(self.keys):
                    self.cache = 2 * len(found)
                self.reset()
        length, as_bytes = end - start, (codes.view(np.uint8), self.pieces[: self.end].view(np.uint8))
        if (self.length[where][back] != length).any():
            return None
        rows = np.flatnonzero(length > 4)  # up to 8 bytes a hash is exact
        if not kit.equal_strings(as_bytes[0], 2 * start[rows], as_bytes[1], 2 * self.of[where][back[rows]], 2 * length[rows]):
            return None
        at, size = self.at[where][back], self.size[where][back]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.flat[kit.ragged(at, size)], ends[np.searchsorted(start, bounds)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        plain, parts = [], []
        for i, text in enumerate(texts):
            text_low = text.lower()
            codes = np.frombuffer(text_low.encode("utf-16-le"), np.uint16) if len(text) == len(text_low) else None
            if codes is None or (len(codes) and codes.max() >= _PLAIN) or "'" in text or "<|" in text or "İ" in text:
                out[i] = np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            else:
                plain.append(i)
                parts.append(codes)
        if parts:
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
            got = self._plain(np.concatenate(parts), bounds)
            for k, i in enumerate(plain):
                out[i] = got[0][got[1][k] : got[1][k + 1]] if got else np.asarray(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out


def _text_runs(texts: list, most: int = 1 << 20) -> Iterator[list[str]]:
    run, size = [], 0
    for text in texts:
        if run and size + len(text or "") > most:
            yield run
            run, size = [], 0
        run.append(text or "")
        size += len(text or "")
    if run:
        yield run


def _cut(path: str, capacity: int, end_id: int, with_ids: bool) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordPieces(path)
        for batch in batches:
            docs, row = batch.column(0), 0
            for run in _text_runs(batch.column(1).to_pylist()):
                which, piece, start, length, crc, kept = [], [], [], [], [], []
                for ids in encoder.encode(run):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        part = ids[at : at + capacity]
                        which.append(row)
                        piece.append(k)
                        start.append(at)
                        length.append(len(part))
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            kept.append(part.tobytes())
                    row += 1
                cols = [docs.take(pa.array(which, pa.int64())).cast(pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(cols + [kit.binaries(kept)] * with_ids, names + ["ids"] * with_ids)

    return cut


def cut_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Tokenize whole texts, append the end id, and cut what is longer than ``capacity``; one row a piece.

    ``with_ids`` adds ``ids``: the piece's ids as little-endian unsigned 32-bit integers.
    """
    kit.bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.transform(kit.mapping, _cut(tokenizer_path, capacity, end_id, with_ids), PIECES + ", ids binary" * with_ids)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` in 1..capacity."""
    spark = pieces.sparkSession
    pieces = kit.written(pieces, "pieces")
    buckets = kit.partitions(spark)
    pieces = pieces.withColumn("__b", F.expr(f"pmod(xxhash64(doc_id, piece), {buckets})"))
    counts = kit.written(pieces.groupBy("length", "__b").agg(F.count("*").alias("__n")), "piece-counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("__n")).collect()}  # at most ``capacity`` rows
    placed, _ = plan_bins(histogram, capacity)
    plan = np.array(placed, np.int64).reshape(-1, 5)
    before = W.partitionBy("length").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("length", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    ranked = pieces.withColumn("__r", F.row_number().over(W.partitionBy("length", "__b").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(offsets, ["length", "__b"]).withColumn("__r", F.col("__from") + F.col("__r") - 1).select(*[c for c in pieces.columns if c != "__b"], "__r")
    stride = np.int64(1) << np.int64(48)
    starts = plan[:, 0] * stride + plan[:, 1]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = kit.ints(batch.column("length"), 0), kit.ints(batch.column("__r"), 0)
            _, base, first, per, offset = plan[np.searchsorted(starts, length * stride + rank, "right") - 1].T
            more = [pa.array(first + (rank - base) // per, pa.int64()), pa.array(offset + (rank - base) % per * length, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], [*batch.schema.names[:-1], "sequence_id", "offset"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "__r")
    return ranked.transform(kit.mapping, look_up, kept + ", sequence_id long, offset long")
