"""Hard negatives by one-dimensional distance keys.

A component x counts as floor(256 * x), a score is the integer inner product. Vectors get one more component, sqrt(M**2 - |v|**2) with M the
largest norm (an anchor's is 0), so that a higher score is a smaller distance: |q - v|**2 = |q|**2 + M**2 - 2 * score. Every vector is stored under the key
(nearest pivot, distance to it): the rows are range-partitioned and sorted by it and written as blocks into the shared folder, and a
directory holds each block's key interval. A search looks at key intervals from its anchor outwards. By the triangle inequality a block's
interval gives the least and largest distance that a vector in it can have, the annulus to be searched; blocks are scanned in growing radius, and a search ends once the
least distance of all that is left certifies its top k: nothing in there can reach the k-th score. Positives are a search among one label; the
negatives of a positive are the best scores in a window, so blocks that lie wholly above the window are left out as well. Results are exact.

Only the pivots come from a sample: the ``SAMPLE`` rows of the smallest hash, clustered on the driver. The directory has at most ``BLOCKS`` blocks and a
few more for pivots and partitions, whatever the number of vectors, and goes to the workers by value. Copies of one vector and label are stored by their smallest
ids alone, as many as a search can return, and a task searches once for equal anchors, so a vector that a third of all rows hold costs what one does.

Defined cases. Rows with a null id, label or vector, with a null or non-finite component, with another dimension than most rows have (of equally frequent ones
the smaller), or with a component so large that a hundred scores may exceed 64 bits, take no part. Equal rows are one; rows that share an id and nothing more
are different rows (and may be positives of each other). Anchors without positives or negatives give no rows, nor do empty tables. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kit

#: Rows that the pivots are clustered from.
SAMPLE = 4096
PIVOTS = 128
#: Rows of a block at least, and blocks at most; larger tables have larger blocks.
BLOCK_ROWS, BLOCKS = 512, 1 << 14
#: Rows of a block that are scored at once, anchors that are searched for at once, and candidates that are held before they are sifted.
SCAN_ROWS, ANCHORS, HELD = 4096, 128, 1 << 18
_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_NONE, _FAR = np.iinfo(np.int64).min, 1 << 61


def components(vectors: DataFrame, label: Column) -> DataFrame:
    """vec_id, label, v (components as integers) of the rows that may take part."""
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0**22))
    usable = vectors.where(F.col("vec_id").isNotNull() & label.isNotNull() & F.col("embedding").isNotNull()).where(fit)
    return usable.select(F.col("vec_id").cast("long"), label.cast("long").alias("label"), whole.alias("v"))


def _longest(size: Column) -> Column:
    """Largest square of a component with which a hundred scores stay in 64 bits."""
    return F.lit(2.0**55) / F.greatest(size, F.lit(1))


@dataclass
class Index:
    """Pivots (with their further component), the directory of blocks, and what bounds need."""

    pivots: np.ndarray
    longest: float  # M**2
    exact: bool  # doubles hold all scores
    uri: list[str]
    at: np.ndarray
    rows: np.ndarray
    pivot: np.ndarray
    near: np.ndarray
    far: np.ndarray
    dims: int

    def distances(self, v: np.ndarray, square: np.ndarray, further: np.ndarray) -> np.ndarray:
        """Distances of rows to all pivots."""
        d = square[:, None] + further[:, None] ** 2 + (self.pivots**2).sum(1)[None] - 2 * (v @ self.pivots[:, :-1].T + further[:, None] * self.pivots[:, -1])
        return np.sqrt(np.maximum(d, 0))

    def block(self, b: int, first: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, labels and vectors of some rows of a block."""
        width = 16 + 4 * self.dims
        raw = kit.map_file(self.uri[b], np.uint8, int(self.at[b]) + first * width, (stop - first) * width)
        raw = raw.take(np.arange((stop - first) * width)) if isinstance(raw, kit.Paged) else raw
        raw = np.asarray(raw).reshape(stop - first, width)
        return raw[:, :8].copy().view("<i8")[:, 0], raw[:, 8:16].copy().view("<i8")[:, 0], raw[:, 16:].copy().view("<i4")


def cluster(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """At most k centres of the rows: the first ones, moved by Lloyd's rounds."""
    centre = np.unique(sample, axis=0)
    centre = centre[np.linspace(0, len(centre) - 1, min(k, len(centre))).astype(int)]
    for _ in range(rounds):
        nearest = ((centre**2).sum(1)[None] - 2 * sample @ centre.T).argmin(1)
        many = np.bincount(nearest, minlength=len(centre))
        for j in np.flatnonzero(many):
            centre[j] = sample[nearest == j].mean(0)
    return centre


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def build(vectors: DataFrame, copies: int) -> tuple[Index, DataFrame] | None:
    """The index over (vec_id, label, v) rows, and the rows with their keys. ``copies``: ids that are kept of one vector and label."""
    spark = vectors.sparkSession
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    widest = F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0)).cast("double")
    sized = vectors.select(F.size("v").alias("d"), square.alias("s"), widest.alias("w")).where(F.col("w") ** 2 <= _longest(F.col("d")))
    most = sized.groupBy("d").agg(F.count("*").alias("n"), F.max("s").alias("s"), F.max("w").alias("w")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not most:
        return None
    dims, count, longest, widest_ = most[0]
    rows = vectors.where((F.size("v") == dims) & (widest**2 <= _longest(F.lit(dims))))
    hashed = rows.select("v", F.xxhash64("vec_id", "label", "v").alias("h"))
    few = F.col("h") <= kit.hash_bound(4 * SAMPLE / count)  # so that tasks need not send SAMPLE rows each
    drawn = hashed.where(few).orderBy("h").limit(SAMPLE).collect() or hashed.orderBy("h").limit(SAMPLE).collect()
    sample = np.array([r.v for r in drawn], float).reshape(len(drawn), dims)
    further = np.sqrt(np.maximum(longest - (sample**2).sum(1), 0))
    none = np.zeros(0, np.int64)
    index = Index(cluster(np.column_stack([sample, further]), PIVOTS), longest, dims * widest_**2 < 2**53, [], none, none, none, none, none, dims)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column("v"), dims)
            s = (v.astype(float) ** 2).sum(1)
            d = index.distances(v, s, np.sqrt(np.maximum(longest - s, 0)))
            pivot = d.argmin(1)
            packed = [x.tobytes() for x in v.astype("<i4")]
            yield pa.record_batch([b.column("vec_id"), b.column("label"), pa.array(pivot.astype(np.int32)), pa.array(d[np.arange(len(v)), pivot]), kit.binaries(packed)], ["vec_id", "label", "pivot", "distance", "v"])

    keys = kit.written(rows.transform(kit.mapping, keyed, "vec_id long, label long, pivot int, distance double, v binary"), "distance-keys")
    size = max(BLOCK_ROWS, -(-count // BLOCKS))
    root = f"{kit.shared_dir(spark)}/distance-blocks-{uuid.uuid4().hex}"

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted; a block holds rows of one pivot, a file some blocks."""
        held: list[bytes] = []
        rows: list[tuple] = []
        uri, at = f"{root}/{uuid.uuid4().hex}", 0
        last, times, open_ = None, 0, False
        for b in batches:
            for i, label, pivot, d, v in zip(*(b.column(c).to_pylist() for c in ("vec_id", "label", "pivot", "distance", "v")), strict=True):
                same = last is not None and last[1:] == (label, v)
                times = times + (last[0] != i) if same else 0
                if same and (last[0] == i or times >= copies):
                    continue
                last = (i, label, v)
                if not open_ or rows[-1][3] != pivot or rows[-1][2] >= size:
                    if at >= 16 << 20:
                        kit.put_file(uri, b"".join(held))
                        uri, at, held = f"{root}/{uuid.uuid4().hex}", 0, []
                    rows.append((uri, at, 0, pivot, d, d))
                    open_ = True
                u, start, n, p, near, _ = rows[-1]
                rows[-1] = (u, start, n + 1, p, near, d)
                row = np.array([i, label], "<i8").tobytes() + v
                held.append(row)
                at += len(row)
        if held:
            kit.put_file(uri, b"".join(held))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64()]
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["uri", "at", "rows", "pivot", "near", "far"])

    order = ["pivot", "distance", "h", "label", "vec_id"]
    dealt = keys.withColumn("h", F.xxhash64("v")).repartitionByRange(kit.partitions(spark), *order).sortWithinPartitions("pivot", "distance", "h", "v", "label", "vec_id")
    blocks = dealt.drop("h").transform(kit.mapping, store, "uri string, at long, rows long, pivot int, near double, far double")
    found = kit.written(blocks, "distance-directory").collect()  # at most BLOCKS, and one for each pivot and partition
    index.uri = [r.uri for r in found]
    index.at, index.rows, index.pivot = (np.array([r[c] for r in found], np.int64) for c in ("at", "rows", "pivot"))
    index.near, index.far = (np.array([r[c] for r in found], float) for c in ("near", "far"))
    return index, keys


class Best:
    """The best k (score, id) of each of n searches; equal scores by the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.search, self.score, self.id, self.label = (np.zeros(0, np.int64) for _ in range(4))
        self.least, self.least_id = np.full(n, _NONE), np.full(n, _NONE)
        self._new: list[tuple[np.ndarray, ...]] = []
        self._many = 0

    def offer(self, search: np.ndarray, score: np.ndarray, id_: np.ndarray, label: np.ndarray) -> None:
        self._new.append((search, score, id_, label))
        self._many += len(search)
        if self._many > HELD:
            self.sift()

    def sift(self) -> None:
        if not self._new:
            return
        search, score, id_, label = (np.concatenate(x) for x in zip((self.search, self.score, self.id, self.label), *self._new, strict=True))
        order = np.lexsort((label, id_, -score, search))
        search, score, id_, label = search[order], score[order], id_[order], label[order]
        first = np.flatnonzero(np.r_[True, search[1:] != search[:-1]]) if len(search) else np.zeros(0, np.int64)
        place = np.arange(len(search)) - np.repeat(first, np.diff(np.r_[first, len(search)]))
        keep = place < self.k
        full = place == self.k - 1
        self.least[search[full]], self.least_id[search[full]] = score[full], id_[full]
        self.search, self.score, self.id, self.label = search[keep], score[keep], id_[keep], label[keep]
        self._new, self._many = [], 0


def search(index: Index, q: np.ndarray, label: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, k: int) -> tuple[Best, int]:
    """The best k of every (anchor, window) among vectors of the anchor's label, or of others; low and high bound its scores (inclusive).
    Searches are numbered anchor * windows + window. Also the number of (anchor, row) scores computed."""
    windows = low.shape[1]
    square = (q.astype(float) ** 2).sum(1)
    d = index.distances(q, square, np.zeros(len(q)))[:, index.pivot]
    slack = 1e-6 * (1 + np.sqrt(index.longest) + np.sqrt(square.max(initial=0)))
    inner = np.maximum(0, np.maximum(index.near - d, d - index.far) - slack)
    outer = d + index.far + slack
    both = square[:, None] + index.longest
    wide = 1 + 1e-9 * both
    most, least = (both - inner**2) / 2 + wide, (both - outer**2) / 2 - wide  # of the scores in each block
    order = np.argsort(inner, axis=1, kind="stable")
    best, scored = Best(len(q) * windows, k), 0
    high_most = high.max(1)
    step, at, blocks = 4, 0, len(index.uri)
    kind = float if index.exact else np.int64
    q = q.astype(kind)
    while at < blocks:
        ring = order[:, at : at + step]
        floor = np.maximum(low, best.least.reshape(len(q), windows)).min(1)  # what a search of the anchor still needs
        live = (np.take_along_axis(most, ring, 1) >= floor[:, None]) & (np.take_along_axis(least, ring, 1) <= high_most[:, None])
        if not (most[np.arange(len(q))[:, None], order[:, at:]] >= floor[:, None]).any():
            break  # certified: nothing further out can enter
        anchor, column = np.nonzero(live)
        block = ring[anchor, column]
        by = np.argsort(block, kind="stable")
        anchor, block = anchor[by], block[by]
        first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]][: len(block)])
        for a, z in zip(first, np.append(first, len(block))[1:], strict=True):
            b, rows = int(block[a]), anchor[a:z]
            for start in range(0, int(index.rows[b]), SCAN_ROWS):
                ids, labels, v = index.block(b, start, min(start + SCAN_ROWS, int(index.rows[b])))
                scores = q[rows] @ v.astype(kind).T
                scored += scores.size
                fits = (labels[None] == label[rows][:, None]) == same
                for w in range(windows):
                    one = rows * windows + w
                    enters = fits & (scores >= np.maximum(low[rows, w], best.least[one])[:, None]) & (scores <= high[rows, w][:, None])
                    r, c = np.nonzero(enters)
                    if len(r):
                        best.offer(one[r], scores[r, c].astype(np.int64), ids[c], labels[c])
        best.sift()
        at, step = at + step, step * 2
    return best, scored


def mine(vectors: DataFrame, label: Column, anchors: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each of an anchor's first ``positives`` rows of its label,
    the first ``negatives`` rows of other labels with least * positive_score <= 100 * negative_score <= most * positive_score."""
    spark = vectors.sparkSession
    kit.bound_batches(spark)
    built = build(kit.written(components(vectors, label), "components"), max(positives, negatives) + 1)
    if built is None:
        return spark.createDataFrame([], _OUT)
    index, keys = built

    def of_group(q: np.ndarray, labels: np.ndarray) -> tuple[Best, Best, np.ndarray]:
        """Positives of some anchors (one more, for the anchor itself) and the negatives of each, numbered anchor * width + positive."""
        width = positives + 1
        open_ = np.full((len(q), 1), _FAR)
        found, _ = search(index, q, labels, True, -open_, open_, width)
        place = np.arange(len(found.search)) - np.searchsorted(found.search, found.search)
        score = np.full((len(q), width), -1)
        score[found.search, place] = found.score
        top = np.where(score >= 0, score * most // 100, -_FAR)  # an empty window where there is no positive, or one below 0
        bottom = np.where(score >= 0, -(-score * least // 100), _FAR)
        return found, search(index, q, labels, False, bottom, top, negatives)[0], place

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = b.column("v").to_pylist()
            labels = kit.ints(b.column("label"), 0)
            ids = kit.ints(b.column("vec_id"), 0)
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(labels.tolist(), packed, strict=True)):
                groups.setdefault(key, []).append(int(ids[i]))
            keys_ = list(groups)
            for at in range(0, len(keys_), ANCHORS):
                some = keys_[at : at + ANCHORS]
                q = np.frombuffer(b"".join(v for _, v in some), "<i4").reshape(len(some), index.dims)
                found, against, place = of_group(q, np.array([x for x, _ in some]))
                rows: list[tuple] = []
                edge = np.searchsorted(found.search, np.arange(len(some) + 1))
                span = np.searchsorted(against.search, np.arange(len(some) * (positives + 1) + 1))
                itself = (q.astype(np.int64) ** 2).sum(1).tolist()
                for j, key in enumerate(some):
                    near = [(int(found.id[x]), int(found.score[x]), j * (positives + 1) + int(place[x])) for x in range(edge[j], edge[j + 1])]
                    for anchor in groups[key]:
                        own = next((x for x in near if x[:2] == (anchor, itself[j])), None)
                        for other, score, n in [x for x in near if x is not own][:positives]:
                            held = [(int(against.id[y]), int(against.score[y])) for y in range(span[n], span[n + 1])]
                            rows += [(anchor, other, r, i, score, s) for r, (i, s) in enumerate(held, 1)]
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    asked = keys.where(anchors).select("vec_id", "label", "v").distinct()
    return asked.repartition(kit.partitions(spark), "vec_id").transform(kit.mapping, work, _OUT)
