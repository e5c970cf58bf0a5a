"""MinHash near-dedup with a multi-index Hamming join.

A document's set is its distinct word shingles; its signature has 60 positions of 16 bits, one minimum
each. Signatures are cut into 10 chunks of 6 positions. Two signatures that differ in at most 19
positions have, by pigeonhole, a chunk with at most one error, so indexing each chunk under its six
one-position-left-out values yields every such pair. At the similarity threshold the chance that a pair
shares no value is below 1e-6 (0.85) or 3e-5 (0.8).

Groups of equal values never emit all their pairs. Sets that are equal form classes first, found by
their fingerprints. Then each class in a group is compared with the group's smallest id only, links are
confirmed on the full sets, and components computed. Groups that still hold several components then
compare members across components, within a task and in blocks: by signature first, and what is left on
the full sets; only links that join components come out. Pairs within a component need no look, so no
link that could change a component is missed.

Defined cases: a document without words has an empty set and is linked with nothing; a null text is one.
Rows that share a doc_id are one node. A null doc_id is linked with nothing, its component is null and
it is kept. Ties do not arise: a component's smallest doc_id stays. Other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit
from .components import connected_components

POSITIONS, CHUNK = 60, 6
CHUNKS = POSITIONS // CHUNK
#: One error in each chunk is allowed, so this many differing positions are always found.
GUARANTEED = 2 * CHUNKS - 1
_RNG = np.random.Generator(np.random.PCG64(77))
_MULTIPLY = _RNG.integers(1, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(1, 2**63, POSITIONS, dtype=np.uint64)
_TAGS = (np.arange(1, POSITIONS + 1, dtype=np.uint64)) << np.uint64(16)
_LEFT_OUT = kit.mix(np.arange(1000, 1000 + POSITIONS, dtype=np.uint64))


def shingle_sets(col: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for a, b, data, bounds in kit.slices(col):
        words = kit.Words(data, bounds, lower=True)
        spans = kit.Spans(words.hashes(), kit._BASE2)
        for i in range(b - a):
            lo, hi = words.first[i], words.first[i + 1]
            if hi - lo >= k:
                at = np.arange(lo, hi - k + 1)
                yield np.unique(spans.of(at, at + k))
            elif hi > lo:
                yield spans.of(np.array([lo]), np.array([hi]))
            else:
                yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(POSITIONS, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[None, at : at + 2048] * _MULTIPLY[:, None]
        part += _ADD[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return (kit.mix(least) & np.uint64(0xFFFF)).astype("<u2")


def index_values(signatures: np.ndarray) -> np.ndarray:
    """(documents, positions): for each position the hash of its chunk without it."""
    each = kit.mix(signatures.astype(np.uint64) + _TAGS)
    chunks = each.reshape(-1, CHUNKS, CHUNK)
    rest = chunks.sum(axis=2, keepdims=True) - chunks
    return kit.mix(rest.reshape(-1, POSITIONS) + _LEFT_OUT).view(np.int64)


def _signatures(docs: DataFrame, k: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b, sig = [], [], [], []
            for s in shingle_sets(batch.column(1), k):
                n.append(len(s))
                a.append(int(kit.mix(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                b.append(int(kit.mix(s ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), kit.binaries(sig)], ["doc_id", "n", "a", "b", "sig"])

    return docs.transform(kit.mapping, sign, "doc_id long, n long, a long, b long, sig binary")


def _index(reps: DataFrame) -> DataFrame:
    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(-1, POSITIONS)
                ids = np.repeat(kit.ints(batch.column(0), 0), POSITIONS)
                yield pa.RecordBatch.from_arrays([pa.array(index_values(sig).ravel()), pa.array(ids)], ["key", "id"])

    return reps.select("id", "sig").transform(kit.mapping, values, "key long, id long")


def _close(pairs: DataFrame, reps: DataFrame, share: int, most: int) -> DataFrame:
    """Drop pairs whose sizes or signatures rule a link out."""
    left = reps.select(F.col("id").alias("p"), F.col("n").alias("np"), F.col("sig").alias("sp"))
    right = reps.select(F.col("id").alias("q"), F.col("n").alias("nq"), F.col("sig").alias("sq"))
    met = pairs.join(left, "p").join(right, "q").where(F.least("np", "nq") * 100 >= F.greatest("np", "nq") * share).select("p", "q", "sp", "sq")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, POSITIONS) for i in (2, 3))
                keep = pa.array((x != y).sum(1) <= most)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["p", "q"])

    return met.transform(kit.mapping, near, "p long, q long").distinct()


def _confirm(pairs: DataFrame, docs: DataFrame, k: int, share: int, per_task: int = 500, broadcast_ids: int = 1_000_000) -> DataFrame:
    """The pairs (p, q) whose full sets pass. Members' texts go to their pivot p; a pivot with many members is dealt over several groups."""
    size = pairs.groupBy("p").agg(F.count("*").alias("m"))
    dealt = pairs.join(size, "p").withColumn("salt", F.expr(f"pmod(xxhash64(q), cast(ceil(m / {per_task}) as bigint))"))
    members = dealt.select("p", "salt", F.col("q").alias("doc_id"), F.lit(1).alias("side"))
    pivots = dealt.select("p", "salt").distinct().select("p", "salt", F.col("p").alias("doc_id"), F.lit(0).alias("side"))
    asked = kit.written(members.unionByName(pivots), "asked")
    ids = asked.select("doc_id").distinct()
    few = ids.count() <= broadcast_ids  # 8 MB of ids
    texts = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    met = asked.join(texts, "doc_id").repartition("p", "salt").sortWithinPartitions("p", "salt", "side").select("p", "salt", "side", "doc_id", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, sets = None, []
        for batch in batches:
            out_p, out_q = [], []
            rows = zip(*(batch.column(i).to_pylist() for i in range(4)), shingle_sets(batch.column(4), k), strict=True)
            for p, salt, side, doc, s in rows:
                if (p, salt) != pivot:
                    pivot, sets = (p, salt), []
                if side == 0:
                    sets.append(s)
                    continue
                for t in sets:
                    both = np.intersect1d(s, t, assume_unique=True).size
                    if both and 100 * both >= share * (len(s) + len(t) - both):
                        out_p.append(p)
                        out_q.append(doc)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(out_p, pa.int64()), pa.array(out_q, pa.int64())], ["p", "q"])

    return met.transform(kit.mapping, compare, "p long, q long").distinct()


def _streamed(rows: DataFrame, by: list[str], work, schema: str) -> DataFrame:
    """Apply ``work`` to the table of each group of ``by`` as the groups of a sorted partition go by."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([kit.ints(batch.column(c), 0) for c in by], 1)
            edge = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
            for i, j in zip(edge, np.append(edge[1:], len(keys)), strict=True):
                key = tuple(keys[i].tolist())
                if key != now and held:
                    yield from work(now, pa.Table.from_batches(held))
                    held = []
                now = key
                held.append(batch.slice(i, j - i))
        if held:
            yield from work(now, pa.Table.from_batches(held))

    return rows.repartition(*by).sortWithinPartitions(*by).transform(kit.mapping, go, schema)


def _open_pairs(key: int, slot: int, table: pa.Table, share: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows in different components that sizes and signatures leave open, closest first.

    A pair that shares several keys belongs to the first of them; a pair of two blocks to their common slot.
    """
    n, comps, blocks = (kit.ints(table.column(c), 0) for c in ("n", "comp", "block"))
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u2").reshape(-1, POSITIONS)
    values = index_values(sig)
    single = slot >> 32 == slot & 0xFFFFFFFF
    order = np.argsort(n, kind="stable")
    stop = np.searchsorted(n[order] * share, n[order] * 100, "right")
    left, right, far = [], [], []
    for at in range(len(order)):
        i, j = order[at], order[at + 1 : stop[at]]
        j = j[comps[j] != comps[i]]
        if not single:
            j = j[blocks[j] != blocks[i]]
        d = (sig[j] != sig[i]).sum(1)
        j, d = j[d <= most], d[d <= most]
        if len(j):
            common = values[j] == values[i]
            mine = values[i][common.argmax(1)] == key
            left.append(np.full(int(mine.sum()), i))
            right.append(j[mine])
            far.append(d[mine])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left, right, far = (np.concatenate(x) for x in (left, right, far))
    order = np.argsort(far, kind="stable")
    return left[order], right[order]


def _across(members: DataFrame, docs: DataFrame, k: int, share: int, most: int, block: int = 2000) -> DataFrame:
    """Links (p, q) that join components within a key; members are rows (key, id, comp, n, sig).

    Groups of more than ``block`` members are compared block by block. A first pass on signatures finds who has an open
    pair; only their texts travel. Within a task a pair that earlier links have joined already is not compared, and
    only joining links come out, so rows stay in proportion to members.
    """
    size = members.groupBy("key").agg(F.count("*").alias("m"))
    dealt = members.join(size, "key").withColumn("nb", F.expr(f"cast(ceil(m / {block}) as bigint)")).withColumn("block", F.expr("pmod(xxhash64(id), nb)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(cast(0 as bigint), nb - 1)")))
    dealt = dealt.withColumn("slot", F.expr("shiftleft(least(block, other), 32) + greatest(block, other)")).select("key", "slot", "id", "comp", "n", "sig", "block")

    def who(key: tuple, table: pa.Table) -> Iterator[pa.RecordBatch]:
        left, right = _open_pairs(*key, table, share, most)
        rows = np.unique(np.concatenate([left, right]))
        if len(rows):
            yield from table.take(pa.array(rows)).combine_chunks().to_batches()

    kind = "key long, slot long, id long, comp long, n long, sig binary, block long"
    asked = kit.written(_streamed(dealt, ["key", "slot"], who, kind), "open")
    ids = asked.select("id").distinct()
    few = ids.count() <= 1_000_000  # 8 MB of ids
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(ids) if few else ids, "id", "left_semi")
    met = asked.join(texts, "id").select("key", "slot", "id", "comp", "n", "sig", "block", "text")

    def compare(key: tuple, table: pa.Table) -> Iterator[pa.RecordBatch]:
        left, right = _open_pairs(*key, table, share, most)
        if not len(left):
            return
        sets = list(shingle_sets(table.column("text"), k))
        ids, comps = kit.ints(table.column("id"), 0).tolist(), kit.ints(table.column("comp"), 0)
        _, node = np.unique(comps, return_inverse=True)
        node, up = node.tolist(), list(range(len(comps)))

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        out = []
        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            a, b = top(node[i]), top(node[j])
            if a == b:
                continue
            s, t = sets[i], sets[j]
            both = np.intersect1d(s, t, assume_unique=True).size
            if both and 100 * both >= share * (len(s) + len(t) - both):
                up[a] = b
                out.append((ids[i], ids[j]))
        if out:
            p, q = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(q, pa.int64())], ["p", "q"])

    return _streamed(met, ["key", "slot"], compare, "p long, q long")


def near_duplicates(docs: DataFrame, k: int = 5, share: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked where 100 * intersection >= ``share`` * union of their sets of ``k``-word shingles.
    """
    kit.bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = kit.written(_signatures(docs, k), "signatures")
    solid = signed.where("n > 0 AND doc_id IS NOT NULL")
    classes = solid.groupBy("a", "b").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    reps = kit.written(classes, "classes")
    # A smaller set is equal to all it could be linked with.
    open_reps = reps.where(F.col("n") * 100 >= (F.col("n") + 1) * share)
    most = int(np.ceil(POSITIONS * (1 - share / 100) + 6 * np.sqrt(POSITIONS * share / 100 * (1 - share / 100))))

    keys = _index(open_reps)
    groups = keys.groupBy("key").agg(F.min("id").alias("p"), F.max("id").alias("top")).where("p < top").select("key", "p")
    stars = keys.join(groups, "key").where("id <> p").select("p", F.col("id").alias("q")).distinct()
    tried = kit.written(_close(stars, open_reps, share, most), "pairs")
    links = kit.written(_confirm(tried, docs, k, share), "links")

    rows = solid.select("doc_id", "a", "b").join(reps.select("a", "b", "id"), ["a", "b"]).select("doc_id", "id")
    split = rows.groupBy("doc_id").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    same = rows.join(split, "doc_id").where("id > lo").select(F.col("lo").alias("p"), F.col("id").alias("q"))
    labels = connected_components(links.unionByName(same))

    # Second look: keys whose members are in several components.
    comp = F.coalesce("component", "id")
    labelled = keys.join(labels, keys["id"] == labels["node"], "left").select("key", "id", comp.alias("comp"))
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    members = labelled.join(mixed, "key", "left_semi").join(open_reps.select("id", "n", "sig"), "id").select("key", "id", "comp", "n", "sig")
    more = kit.written(_across(members, docs, k, share, most), "links")
    if more.limit(1).count():
        labels = connected_components(more.unionByName(labels.select(F.col("component").alias("p"), F.col("node").alias("q"))))

    found = signed.select("doc_id", "n", "a", "b").join(reps.select("a", "b", "id"), ["a", "b"], "left")
    found = found.join(labels, found["id"] == labels["node"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "id", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
