"""Exact substring dedup with super-k-mer partitioning.

A window is ``width`` consecutive words of a document. Each window's minimiser is the smallest hash
of its ``inner``-word runs. Consecutive windows sharing a minimiser form a super-k-mer, whose words
travel once, as one packed string, to the minimiser's bucket; equal windows have equal minimisers, so
they meet. In a bucket the windows are sorted and runs of equal ones counted; the first occurrence by
(doc_id, start) stays, and byte comparison with it confirms every other.

Hot passages: each map task first collapses equal super-k-mers to their first occurrence, so a
passage that a third of the corpus shares sends one row per task. Runs that a sample of the corpus holds often rank behind all others as
minimisers, so a frequent phrase in ever new surroundings does not fill one bucket (any order of runs gives the same windows). A bucket is
read in several passes over ranges of window hashes where it exceeds ``bucket_bytes``; a pass holds 16 bytes a window, and then the texts of
windows whose hash occurs again, cut out of their blocks.

Defined cases: a document is identified by (doc_id, text): repeated rows count as one document and get
equal results. Documents that share a doc_id but not the text are ordered by their text's hash; a null
doc_id comes after all others. A null or empty text has no words. Other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit

_LAST = np.int64(2**63 - 1)
_RECORD = np.dtype([("doc", "<i8"), ("tie", "<i8"), ("start", "<i4"), ("words", "<i4")])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` neighbours, by doubling."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def run_hashes(words: kit.Words, inner: int) -> np.ndarray:
    at = np.arange(max(0, len(words.start) - inner + 1))
    return kit.Spans(words.hashes(), kit._BASE2).of(at, at + inner)


def frequent_runs(docs: DataFrame, inner: int, sample: int = 4000, share: float = 0.005, most: int = 10_000) -> np.ndarray:
    """Sorted hashes of word runs that ``share`` of about ``sample`` documents hold, chosen by a hash of their text; at most ``most``.

    They decide the order of minimisers alone, so neither bound loses a window.
    """
    n = docs.count()
    chosen = docs.select("text").where(F.expr(f"pmod(xxhash64(text, 31), 1048576) < {min(1.0, sample / max(1, n)) * 1048576}"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, bounds in kit.slices(batch.column(0)):
                words = kit.Words(data, bounds)
                h = run_hashes(words, inner)
                doc = np.repeat(np.arange(len(words.counts)), words.counts)[: len(h)]
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])][: len(h)]
                h, many = np.unique(h[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(many, pa.int64())], ["h", "n"])

    least = max(8, int(share * min(n, sample)))
    found = chosen.transform(kit.mapping, runs, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(np.array([r[0] for r in found.orderBy(F.desc("n"), "h").limit(most).collect()], np.int64).view(np.uint64))


def super_kmers(words: kit.Words, width: int, inner: int, frequent: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(document, first word, word count, minimiser) of every super-k-mer; word numbers count over all of ``words``."""
    n = len(words.start)
    if n < width:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    runs = run_hashes(words, inner)
    last = np.zeros(len(runs), np.uint64)
    if frequent is not None and len(frequent):
        last = (frequent[np.minimum(np.searchsorted(frequent, runs), len(frequent) - 1)] == runs).astype(np.uint64)
    least = sliding_min(runs >> np.uint64(1) | last << np.uint64(63), width - inner + 1)
    doc = np.repeat(np.arange(len(words.counts)), words.counts)
    whole = doc[: n - width + 1] == doc[width - 1 :]
    window = np.flatnonzero(whole)
    if not len(window):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    new = np.ones(len(window), bool)
    new[1:] = (least[window[1:]] != least[window[:-1]]) | (doc[window[1:]] != doc[window[:-1]])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(window))) + width - 1
    return doc[window[first]], window[first], size, least[window[first]]


def intervals(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Per document the merged word intervals, packed as pairs of 32-bit integers."""
    if not len(doc):
        return
    order = np.lexsort((start, tie, doc))
    doc, tie, start, end = doc[order], tie[order], start[order], end[order]
    edge = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])])
    for a, b in zip(edge, np.append(edge[1:], len(doc)), strict=True):
        s, e = start[a:b], np.maximum.accumulate(end[a:b])
        new = np.r_[True, s[1:] > e[:-1]]
        last = np.r_[np.flatnonzero(new)[1:] - 1, len(s) - 1]
        yield int(doc[a]), int(tie[a]), np.stack([s[new], e[last]], 1).astype("<i4").tobytes()


class _Collector:
    """Super-k-mers of one map task: equal ones collapse to the first, the rest is known to repeat."""

    def __init__(self, width: int, inner: int, buckets: int, frequent: np.ndarray):
        self.width, self.inner, self.buckets, self.frequent = width, inner, buckets, frequent
        self.pack = zstandard.ZstdCompressor(level=1)
        self.clear()

    def clear(self) -> None:
        self.records, self.hashes, self.owner, self.parts, self.size = [], [], [], [], 0

    def add(self, words: kit.Words, docs: np.ndarray, ties: np.ndarray) -> None:
        doc, first, size, least = super_kmers(words, self.width, self.inner, self.frequent)
        if not len(doc):
            return
        text, start, end = words.packed()
        s, e = start[first], end[first + size - 1]
        self.parts += [text[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]
        record = np.empty(len(doc), _RECORD)
        record["doc"], record["tie"], record["start"], record["words"] = docs[doc], ties[doc], first - words.first[doc], size
        self.records.append(record)
        self.hashes.append(kit.Spans(words.hashes()).of(first, first + size))
        self.owner.append((kit.mix(least) % np.uint64(self.buckets)).astype(np.int32))
        self.size += int((e - s).sum())

    def flush(self) -> Iterator[tuple]:
        """Rows (bucket, doc, tie, block): blocks for buckets, then known intervals (bucket -1)."""
        if not self.records:
            return
        record, owner, parts = np.concatenate(self.records), np.concatenate(self.owner), self.parts
        _, back = np.unique(np.concatenate(self.hashes), return_inverse=True)
        order = np.lexsort((record["start"], record["tie"], record["doc"], back))
        head = np.r_[True, back[order[1:]] != back[order[:-1]]]
        first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        keep, repeat = np.zeros(len(order), bool), []
        keep[order[head]] = True
        for i, j in zip(order[~head].tolist(), first[~head].tolist(), strict=True):
            if parts[i] != parts[j]:
                keep[i] = True  # a hash collision: send it on as it is
            else:
                repeat.append((i, j))
        if repeat:
            i, j = np.array(repeat).T
            other = (record["doc"][i] != record["doc"][j]) | (record["tie"][i] != record["tie"][j]) | (record["start"][i] != record["start"][j])
            r = record[i[other]]
            yield from ((-1, *x) for x in intervals(r["doc"], r["tie"], r["start"].astype(np.int64), r["start"].astype(np.int64) + r["words"]))
        chosen = np.flatnonzero(keep)
        chosen = chosen[np.argsort(owner[chosen], kind="stable")]
        cut = np.flatnonzero(np.r_[True, owner[chosen[1:]] != owner[chosen[:-1]]])
        for a, b in zip(cut, np.append(cut[1:], len(chosen)), strict=True):
            rows = chosen[a:b]
            body = b"\n".join([parts[i] for i in rows.tolist()])
            yield int(owner[rows[0]]), None, None, self.pack.compress(len(rows).to_bytes(8, "little") + record[rows].tobytes() + body)
        self.clear()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    bucket, doc, tie, block = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(doc, pa.int64()), pa.array(tie, pa.int64()), kit.binaries(list(block))], ["bucket", "doc", "tie", "block"])


def _in_batches(rows: Iterator[tuple], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    run, size = [], 0
    for row in rows:
        run.append(row)
        size += len(row[3]) + 24
        if size > most:
            yield _batch(run)
            run, size = [], 0
    if run:
        yield _batch(run)


def _unpack(blocks: list[bytes]) -> Iterator[tuple[np.ndarray, bytes]]:
    open_ = zstandard.ZstdDecompressor()
    for block in blocks:
        raw = open_.decompress(block)
        n = int.from_bytes(raw[:8], "little")
        yield np.frombuffer(raw, _RECORD, n, 8), raw[8 + n * _RECORD.itemsize :]


def _windows(record: np.ndarray, body: bytes, width: int) -> tuple[kit.Words, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a block, and each window's first word, super-k-mer and that one's first word."""
    words = kit.Words(np.frombuffer(body, np.uint8), np.array([0, len(body)]))
    size = record["words"].astype(np.int64)
    base = np.cumsum(size) - size
    at = kit.ragged(base, size - width + 1)
    owner = np.repeat(np.arange(len(record)), size - width + 1)
    return words, at, owner, base


def _cut_out(body: bytes, start: np.ndarray, end: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The parts of a block that some span covers, one after the other, and where each span starts there."""
    order = np.argsort(start, kind="stable")
    s, e = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, s[1:] > e[:-1]]
    head = np.flatnonzero(new)
    stop = e[np.r_[head[1:] - 1, len(s) - 1]]
    kept = np.cumsum(stop - s[head]) - (stop - s[head])
    at = np.empty(len(s), np.int64)
    group = np.cumsum(new) - 1
    at[order] = kept[group] + s - s[head][group]
    return b"".join([body[a:b] for a, b in zip(s[head].tolist(), stop.tolist(), strict=True)]), at


def repeats_in_bucket(blocks: list[bytes], width: int, most: int) -> Iterator[tuple[int, int, bytes]]:
    """Sort a bucket's windows; yield the intervals of all but the first occurrence of each."""
    total = sum(zstandard.frame_content_size(b) for b in blocks)
    passes = max(1, -(-total // most))
    for turn in range(passes):
        hashes, places, counts = [], [], []
        for record, body in _unpack(blocks):
            words, at, _, _ = _windows(record, body, width)
            h = kit.Spans(words.hashes()).of(at, at + width)
            place = np.flatnonzero(h % np.uint64(passes) == turn) if passes > 1 else np.arange(len(h))
            hashes.append(h[place])
            places.append(place.astype(np.int32))
            counts.append(len(place))
        h = np.concatenate(hashes)
        del hashes
        if not len(h):
            continue
        order = kit.order_of(h)
        same = h[order[1:]] == h[order[:-1]]
        again = np.zeros(len(h), bool)
        again[order[np.r_[False, same] | np.r_[same, False]]] = True
        del order, same
        edge = np.concatenate([[0], np.cumsum(counts)])
        h, texts, found = h[again], [], []
        for b, (a, z) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
            place = places[b][again[a:z]]
            texts.append(b"")
            if not len(place):
                continue
            record, body = next(_unpack(blocks[b : b + 1]))
            words, at, owner, base = _windows(record, body, width)
            at, owner = at[place], owner[place]
            lo, hi = words.start[at], words.end[at + width - 1]
            texts[b], begin = _cut_out(body, lo, hi)
            found.append((record["doc"][owner], record["tie"][owner], record["start"][owner] + (at - base[owner]), begin, begin + hi - lo, np.full(len(at), b)))
        if not found:
            continue
        doc, tie, start, lo, hi, block = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((start, tie, doc, h))
        h, doc, tie, start, lo, hi, block = (x[order] for x in (h, doc, tie, start, lo, hi, block))
        head = np.r_[True, h[1:] != h[:-1]]
        first = np.maximum.accumulate(np.where(head, np.arange(len(h)), 0))
        other = (doc != doc[first]) | (tie != tie[first]) | (start != start[first])
        hit, group, key = [], {}, -1
        for i, f, a, b, k, fa, fb, fk in zip(*(x.tolist() for x in (np.flatnonzero(other), first[other], lo[other], hi[other], block[other], lo[first[other]], hi[first[other]], block[first[other]])), strict=True):
            text = texts[k][a:b]
            if text == texts[fk][fa:fb]:
                hit.append(i)
                continue
            if f != key:  # windows whose hashes collide: count by their text
                group, key = {}, f
            if group.setdefault(text, i) != i:
                hit.append(i)
        hit = np.array(hit, np.int64)
        yield from intervals(doc[hit], tie[hit], start[hit].astype(np.int64), start[hit].astype(np.int64) + width)


def repeated_intervals(docs: DataFrame, width: int = 20, inner: int = 4, flush_bytes: int = 64 << 20, bucket_bytes: int = 128 << 20) -> DataFrame:
    """Rows (doc_id, tie, spans): word intervals covered by windows that also start earlier; several rows a document."""
    buckets = 4 * kit.partitions(docs.sparkSession)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            collector = _Collector(width, inner, buckets, frequent)
            for batch in batches:
                ids, ties = kit.ints(batch.column(0), _LAST), kit.ints(batch.column(1), 0)
                for a, b, data, bounds in kit.slices(batch.column(2)):
                    collector.add(kit.Words(data, bounds), ids[a:b], ties[a:b])
                    if collector.size > flush_bytes:
                        yield from collector.flush()
            yield from collector.flush()

        yield from _in_batches(rows())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            blocks, now = [], None
            for batch in batches:
                for bucket, doc, tie, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if bucket < 0:
                        yield bucket, doc, tie, block
                        continue
                    if bucket != now:
                        if blocks:
                            yield from ((-1, *x) for x in repeats_in_bucket(blocks, width, bucket_bytes))
                        blocks, now = [], bucket
                    blocks.append(block)
            if blocks:
                yield from ((-1, *x) for x in repeats_in_bucket(blocks, width, bucket_bytes))

        yield from _in_batches(rows())

    kind = "bucket int, doc long, tie long, block binary"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text").cast("string").alias("text"))
    frequent = frequent_runs(rows, inner)
    blocks = rows.transform(kit.mapping, split, kind)
    # Known repeats carry bucket -1: deal them by document, so that they do not meet in one task.
    dealt = blocks.repartition(F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.hash("doc", "tie"))).sortWithinPartitions("bucket")
    found = dealt.transform(kit.mapping, count, kind)
    return found.select(F.col("doc").alias("doc_id"), "tie", F.col("block").alias("spans"))


def remove_repeats(docs: DataFrame, width: int = 20, inner: int = 4, **limits: int) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_text (kept words joined by one space), removed (array of word intervals)."""
    kit.bound_batches(docs.sparkSession)
    spans = kit.written(repeated_intervals(docs, width, inner, **limits), "repeats")
    spans = spans.groupBy(F.col("doc_id").alias("__d"), F.col("tie").alias("__t")).agg(F.collect_list("spans").alias("__s"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(spans, (F.coalesce("doc_id", F.lit(int(_LAST))) == F.col("__d")) & (F.xxhash64("text") == F.col("__t")), "left").select("doc_id", "text", "__s")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept, removed = [], [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (text or "").encode().split()
                n_words.append(len(words))
                if found:
                    pairs = np.concatenate([np.frombuffer(x, "<i4").reshape(-1, 2) for x in found])
                    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")].tolist()
                    out, merged, at = [], [], 0
                    for s, e in pairs:
                        if merged and s <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], e)
                        else:
                            merged.append([s, e])
                    for s, e in merged:
                        out += words[at:s]
                        at = e
                    words = out + words[at:]
                    removed.append([{"start": s, "end": e} for s, e in merged])
                else:
                    removed.append([])
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                ["doc_id", "n_words", "n_removed", "kept_text", "removed"],
            )

    return rows.transform(kit.mapping, keep, "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:int,end:int>>")
