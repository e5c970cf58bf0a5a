"""A stored full-text index: postings clustered by token, kept in step with the table by deltas.

An index is a folder of committed parts. A part has the postings of the documents that it adds or replaces, in blocks: a token's postings in a run of
1,024 keys, and for each piece of 64 keys the largest count, the smallest length and a bit for each key. The documents of a run are cut into tokens
in one task, which makes its blocks, so that no posting moves alone. Blocks move packed into bytes, without what a later part takes back. They are sorted and
range-partitioned by token, so that a look-up reads the row groups of its tokens alone; one short row for each document that it touches; and
how many documents and tokens it adds, signed. A posting counts unless a later part touches its document. ``compact`` folds all parts into a base, in
which every posting counts.

A search for the best k reads the blocks' figures first: these bound the score of every document in a piece, and give how many documents hold a term. The
pieces of the highest bounds are scored; of the others only those are read whose bound reaches the k-th score found there.

Queries read their tokens' postings, the parts' totals and the keys that later parts touch; never the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..storage import BASE, Log, again, shuffles_released

_STATS = "documents long, tokens long"
#: A block: figures of its pieces (largest tf, smallest n, the keys' bits; none in a short block), then the postings side by side; the positions of all, one after the other (tf of each).
_BLOCK = "token string, run long, heads array<struct<piece:long,top:int,least:int,bits:long>>, keys array<long>, tfs array<int>, ns array<int>, places array<int>"
_COLUMNS = ["token", "run", "heads", "keys", "tfs", "ns", "places"]
#: A block on its way: its postings as one string of whole numbers of 7 bits a byte.
_PACKED = "token string, run long, packed binary"
#: Packed blocks, and for each run a row without a token: its documents, with null lengths of deleted ones.
_MADE = f"{_PACKED}, keys array<long>, ns array<int>"
_HEAD = {"piece": pa.int64(), "top": pa.int32(), "least": pa.int32(), "bits": pa.int64()}
#: Bits of a key within its piece, and within its run.
_PIECE, _RUN = 6, 10
#: Postings from which on a block has figures of its pieces; of fewer, each stands for itself.
_MANY = 32
#: Pieces that are named one by one in the scan; more are joined.
_NAMED = 2000
#: Tokens that are sorted at once, but for more of them in one run.
_TOKENS = 1 << 16
#: Rows of changed keys, one a run and part, that are broadcast when parts are folded (64 MB); more are joined by a shuffle.
_BROADCAST = 1 << 18
#: Blocks are sorted in so many ranges of tokens at most, one after the other, each of so many stored bytes at least: only one of them is in shuffle files at a time.
_PASSES, _PASS_BYTES = 4, 32 << 20


def _minus(k: int) -> Callable[[Column], Column]:
    return lambda p: p - k


def _whole_groups(batches: Iterator[pa.RecordBatch], start: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches cut between groups, with the rows at which their groups start. ``start``: whether a row, but the first, begins a group."""
    kept = None
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = batch if kept is None else pa.concat_batches([kept, batch])
        first = np.flatnonzero(np.r_[True, start(whole)])
        kept = whole.slice(first[-1])
        if len(first) > 1:
            yield whole.slice(0, first[-1]), first[:-1]
    if kept is not None:
        yield kept, np.zeros(1, np.int64)


def _sizes(lists: pa.Array) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _lists(edges: np.ndarray, values: np.ndarray, mask: np.ndarray | None = None) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values, mask=mask))


def _order(codes: np.ndarray, below: int) -> np.ndarray:
    """A stable order of whole numbers under ``below``, by digits of 16 bits, which numpy sorts by radix."""
    order = np.argsort(codes.astype(np.uint16), kind="stable")
    for digit in range(16, below.bit_length(), 16):
        order = order[np.argsort((codes[order] >> digit).astype(np.uint16), kind="stable")]
    return order


def _batch_of_blocks(token: pa.Array, first: np.ndarray, key: np.ndarray, tf: np.ndarray, n: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """Blocks that start at the postings ``first``, from postings sorted by block and key."""
    edge, upto, piece = np.r_[first, len(key)], np.r_[0, np.cumsum(tf)], key >> _PIECE
    new = np.r_[True, piece[1:] != piece[:-1]]
    new[first] = True
    head = np.flatnonzero(new & np.repeat(np.diff(edge) >= _MANY, np.diff(edge)))
    if len(head):
        starts = np.flatnonzero(new)
        here = np.searchsorted(starts, head)
        of = lambda f, values: f.reduceat(values, starts)[here]
        figures = [piece[head], of(np.maximum, tf).astype(np.int32), of(np.minimum, n).astype(np.int32), of(np.bitwise_or, np.left_shift(np.int64(1), key & 63))]
    else:
        figures = [np.zeros(0, t.to_pandas_dtype()) for t in _HEAD.values()]
    heads = pa.StructArray.from_arrays(list(map(pa.array, figures)), list(_HEAD))
    edges = pa.array(np.searchsorted(head, edge).astype(np.int32))
    lists = [_lists(edge, key), _lists(edge, tf.astype(np.int32)), _lists(edge, n.astype(np.int32)), _lists(upto[edge], places.astype(np.int32))]
    return pa.RecordBatch.from_arrays([token, pa.array(key[first] >> _RUN), pa.ListArray.from_arrays(edges, heads), *lists], _COLUMNS)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whole numbers from each start on, as many as its size."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _steps(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each value less the one before it; those at ``first`` as they are."""
    out = np.diff(values, prepend=0)
    out[first] = values[first]
    return out


def _sums(steps: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values of ``_steps``."""
    total = np.cumsum(steps)
    return total - np.repeat(total[first] - steps[first], sizes)


def _packed(first: np.ndarray, key: np.ndarray, tf: np.ndarray, n: np.ndarray, places: np.ndarray) -> pa.Array:
    """Blocks that start at the postings ``first``, as bytes: how many postings, then their keys (as steps), counts, lengths and places (as steps)."""
    count = np.diff(np.r_[first, len(key)])
    held = np.add.reduceat(tf, first)
    size = 1 + 3 * count + held
    begin = np.cumsum(size) - size
    values = np.empty(int(size.sum()), np.int32)
    values[begin] = count
    values[_ranges(begin + 1, count)] = _steps(key & ((1 << _RUN) - 1), first)
    values[_ranges(begin + 1 + count, count)] = tf
    values[_ranges(begin + 1 + 2 * count, count)] = n
    values[_ranges(begin + 1 + 3 * count, held)] = _steps(places, np.cumsum(tf) - tf)
    long = np.ones(len(values), np.uint8)
    for bits in (7, 14, 21, 28):
        long += values >> bits > 0
    upto = np.r_[0, np.cumsum(long, dtype=np.int64)]
    data = np.empty(upto[-1], np.uint8)
    at, left = upto[:-1], np.arange(len(values))
    for byte in range(int(long.max())):
        left = left[long[left] > byte]
        data[at[left] + byte] = (values[left] >> 7 * byte) & 127 | (long[left] > byte + 1).astype(np.uint8) << 7
    edges = upto[np.r_[begin, len(values)]].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(edges), pa.py_buffer(data)])


def _unpacked(packed: pa.Array) -> tuple[np.ndarray, ...]:
    """How many postings each block has; and of all postings the keys within their runs, the counts and the lengths; and the places of all."""
    edges = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)
    data = np.frombuffer(packed.buffers()[2], np.uint8)[edges[0] : edges[-1]]
    last = np.flatnonzero(data < 128)
    start = np.r_[0, last[:-1] + 1]
    long, values = last - start + 1, (data[start] & 127).astype(np.int32)
    for byte in range(1, int(long.max())):
        some = np.flatnonzero(long > byte)
        values[some] |= (data[start[some] + byte] & 127).astype(np.int32) << 7 * byte
    begin = np.searchsorted(start, edges - edges[0])
    count = values[begin[:-1]].astype(np.int64)
    first = np.cumsum(count) - count
    part = lambda i: values[_ranges(begin[:-1] + 1 + i * count, count)].astype(np.int64)
    key, tf, n = _sums(part(0), first, count), part(1), part(2)
    places = values[_ranges(begin[:-1] + 1 + 3 * count, np.diff(begin) - 1 - 3 * count)].astype(np.int64)
    return count, key, tf, n, _sums(places, np.cumsum(tf) - tf, tf)


def _blocks_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed blocks from (run, key, t) sorted by run and key, where of several rows with one key the last counts; and for each run a row without a token: its documents, with null lengths where t is null."""
    differ = lambda x: x[1:] != x[:-1]
    for whole, _ in _whole_groups(batches, lambda b: differ(b.column("run").to_numpy())):
        key = whole.column("key").to_numpy()
        last = np.r_[differ(key), True]
        if not last.all():
            whole, key = whole.filter(pa.array(last)), key[last]
        run, texts = key >> _RUN, whole.column("t")
        first = np.flatnonzero(np.r_[True, differ(run)])
        edge, size = np.r_[first, len(key)], _sizes(texts)
        lengths = _lists(edge, size.astype(np.int32), texts.is_null().to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(first), pa.string()), pa.array(run[first]), pa.nulls(len(first), pa.binary()), _lists(edge, key), lengths], ["token", "run", "packed", "keys", "ns"])
        ends = np.r_[0, np.cumsum(size)]
        at = 0
        while at < len(first):
            stop = max(at + 1, int(np.searchsorted(ends[edge], ends[edge[at]] + _TOKENS, "right")) - 1)
            rows = slice(edge[at], edge[stop])
            at = stop
            n, keys = size[rows], key[rows]
            if not n.any():
                continue
            coded = texts.slice(rows.start, rows.stop - rows.start).flatten().dictionary_encode()
            code, document = coded.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(n)), n)
            order = _order(code, len(coded.dictionary))
            part = np.cumsum(np.r_[0, differ(keys >> _RUN)])
            if part[-1]:
                order = order[_order(part[document[order]], int(part[-1]) + 1)]
            code, document = code[order], document[order]
            place = order - (np.cumsum(n) - n)[document]
            posting = np.flatnonzero(np.r_[True, differ(code) | differ(document)])
            tf = np.diff(np.r_[posting, len(code)])
            code, document = code[posting], document[posting]
            block = np.flatnonzero(np.r_[True, differ(code) | differ(part[document])])
            token, key_of = coded.dictionary.take(pa.array(code[block])), keys[document]
            none = [pa.nulls(len(block), pa.list_(t)) for t in (pa.int64(), pa.int32())]
            yield pa.RecordBatch.from_arrays([token, pa.array(key_of[block] >> _RUN), _packed(block, key_of, tf, n[document], place), *none], ["token", "run", "packed", "keys", "ns"])


def _counting_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed blocks from stored ones, without the postings whose bit is in ``stale``."""
    for whole in batches:
        flat = {c: whole.column(c).flatten().to_numpy() for c in ("keys", "tfs", "ns", "places")}
        row = np.repeat(np.arange(whole.num_rows), _sizes(whole.column("keys")))
        key, tf, words = flat["keys"], flat["tfs"].astype(np.int64), whole.column("stale")
        size, masks = _sizes(words), words.flatten().to_numpy()
        some, masked = np.ones(len(key), bool), np.flatnonzero(size[row])
        word = (np.cumsum(size) - size)[row[masked]] + ((key[masked] >> _PIECE) & ((1 << _RUN - _PIECE) - 1))
        some[masked] = (masks[word] >> (key[masked] & 63)) & 1 == 0
        some = np.flatnonzero(some)
        if not len(some):
            continue
        places = flat["places"][_ranges((np.cumsum(tf) - tf)[some], tf[some])]
        block = np.flatnonzero(np.r_[True, np.diff(row[some]) != 0])
        left = pa.array(row[some][block])
        yield pa.RecordBatch.from_arrays([whole.column("token").take(left), whole.column("run").take(left), _packed(block, key[some], tf[some], flat["ns"][some], places)], ["token", "run", "packed"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block a (token, run) from packed blocks sorted by these."""

    def start(b: pa.RecordBatch) -> np.ndarray:
        token, run = b.column("token"), b.column("run").to_numpy()
        return (run[1:] != run[:-1]) | pc.not_equal(token.slice(1), token.slice(0, len(token) - 1)).to_numpy(zero_copy_only=False)

    for whole, first in _whole_groups(batches, start):
        count, key, tf, n, places = _unpacked(whole.column("packed"))
        group = np.repeat(np.repeat(np.arange(len(first)), np.diff(np.r_[first, whole.num_rows])), count)
        key += np.repeat(whole.column("run").to_numpy() << _RUN, count)
        if len(first) < whole.num_rows:
            order = np.argsort((group << _RUN) + (key & ((1 << _RUN) - 1)), kind="stable")
            places = places[_ranges((np.cumsum(tf) - tf)[order], tf[order])]
            group, key, tf, n = group[order], key[order], tf[order], n[order]
        block = np.flatnonzero(np.r_[True, np.diff(group) != 0])
        yield _batch_of_blocks(whole.column("token").take(pa.array(first)), block, key, tf, n, places)


class TextIndex:
    """The index of one text column; ``key`` is a long column that identifies a row.

    A null text has no tokens and counts as a document of length 0; a null key cannot be addressed and is not indexed; of several rows with
    one key in a batch the one with the largest text counts.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.folder = Log(spark, self.root)

    # -- writing

    @property
    def exists(self) -> bool:
        return bool(self.folder.live())

    def _read(self, part: str, schema: str, names: Sequence[str]) -> DataFrame:
        """Rows of the parts, with the number of their part in ``seq``."""
        if not names:
            return self.spark.createDataFrame([], f"{schema}, seq long")
        return self.spark.read.schema(f"{schema}, seq long").parquet(*[f"{self.root}/{n}/{part}" for n in names])

    def _blocks(self, names: Sequence[str]) -> DataFrame:
        return self._read("blocks", _BLOCK, names)

    @staticmethod
    def _opened(blocks: DataFrame, places: bool = True) -> DataFrame:
        """Blocks as postings."""
        lists = ["keys", "tfs", "ns"]
        if places:
            upto = lambda i: F.aggregate(F.slice("tfs", F.lit(1), i), F.lit(0), lambda a, x: a + x)
            blocks = blocks.withColumn("at", F.transform("tfs", lambda x, i: F.slice("places", upto(i) + 1, x)))
            lists.append("at")
        each = blocks.select("token", "seq", F.explode(F.arrays_zip(*lists)).alias("p"))
        return each.select("token", F.col("p.keys").alias("key"), F.col("p.tfs").alias("tf"), F.col("p.ns").alias("n"), *[F.col("p.at").alias("positions")] * places, "seq")

    def _documents(self, names: Sequence[str]) -> DataFrame:
        return self._read("documents", "key long, n int", names)

    def update(self, rows: DataFrame, key: str, text: str) -> None:
        """Add documents, or replace those that are there."""
        docs = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        self._commit(docs)

    def delete(self, keys: DataFrame, key: str) -> None:
        """Take documents out; unknown ones change nothing."""
        gone = keys.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key")).distinct()
        self._commit(gone.withColumn("text", F.lit(None).cast("string")))

    def _commit(self, docs: DataFrame) -> None:
        """Write a part from (key, text); null texts delete. What it changes in the totals depends on the parts before, so after a conflict it is written again."""
        again(lambda: self._commit_once(docs))

    def _commit_once(self, docs: DataFrame) -> None:
        with self.folder.part() as part, shuffles_released(self.spark):
            at, live, seq = part.path, part.live, part.number
            # the documents of a run come together, so its blocks are made in its task and no posting moves alone; once, though several plans read them
            runs = docs.withColumn("run", F.shiftright("key", _RUN)).repartition("run").sortWithinPartitions("run", "key", "text")
            self._write(runs.select("run", "key", tx.tokens(F.col("text")).alias("t")).mapInArrow(_blocks_of_runs, _MADE), f"{at}/made")
            made = self.spark.read.schema(_MADE).parquet(f"{at}/made")
            number = F.lit(seq).cast("long").alias("seq")
            packed = made.where("token IS NOT NULL").select("token", "run", "packed")
            for part_of in self._passes(packed, F.length("packed"), [f"{at.rpartition('/')[2]}/made"]):
                self._write(self._sorted(packed.where(part_of)).select("*", number), f"{at}/blocks")
            touched = made.where("token IS NULL").select(F.explode(F.arrays_zip("keys", "ns")).alias("d"))
            touched.select(F.col("d.keys").alias("key"), F.col("d.ns").alias("n"), number).write.parquet(f"{at}/documents")
            # what these documents counted before
            mine = self.spark.read.parquet(f"{at}/documents")
            old = self._newest(live).join(mine.select("key"), "key", "left_semi").where("n IS NOT NULL")
            change = mine.where("n IS NOT NULL").select(F.lit(1).alias("d"), "n").unionByName(old.select(F.lit(-1).alias("d"), "n"))
            total = change.agg(F.coalesce(F.sum("d"), F.lit(0)).cast("long").alias("documents"), F.coalesce(F.sum(F.col("d") * F.col("n")), F.lit(0)).cast("long").alias("tokens"))
            total.withColumn("seq", F.lit(seq).cast("long")).write.parquet(f"{at}/stats")
            self.folder.delete(f"{at.rpartition('/')[2]}/made")

    @staticmethod
    def _sorted(packed: DataFrame) -> DataFrame:
        """Whole blocks by ranges of (token, run), so that a frequent token spans several."""
        return packed.repartitionByRange("token", "run").sortWithinPartitions("token", "run").mapInArrow(_merged, _BLOCK)

    def _passes(self, blocks: DataFrame, weight: Column, stored: Sequence[str]) -> list[Column]:
        """Conditions on ``token``, of which each block meets one, so that they part the blocks about evenly. Some 4,096 blocks tell where; only the balance depends on them."""
        n = min(_PASSES, 1 + self.folder.bytes(list(stored)) // _PASS_BYTES)
        if n < 2:
            return [F.lit(True)]
        step = max(1, blocks.count() // 4096)
        some = blocks.where(F.pmod(F.xxhash64("token", "run"), F.lit(step)) == 0).select("token", weight.alias("w")).collect()
        some.sort(key=lambda r: r.token.encode())
        upto = np.cumsum([r.w for r in some])
        at = np.searchsorted(upto, [upto[-1] * i // n for i in range(1, n)]) if some else []
        bounds = sorted({some[i].token for i in at}, key=str.encode)
        token = F.col("token")
        return [(F.lit(True) if a is None else token >= a) & (F.lit(True) if b is None else token < b) for a, b in zip([None, *bounds], [*bounds, None], strict=True)]

    @staticmethod
    def _write(blocks: DataFrame, at: str) -> None:
        blocks.write.option("parquet.block.size", 8 << 20).option("compression", "zstd").mode("append").parquet(at)

    def _newest(self, names: Sequence[str]) -> DataFrame:
        return self._documents(names).groupBy("key").agg(F.max_by("n", "seq").alias("n"), F.max("seq").alias("seq"))

    def _counting(self, rows: DataFrame, names: Sequence[str]) -> DataFrame:
        """Postings that no later part takes back."""
        later = [n for n in names if not n.endswith(BASE)]
        if not later or len(names) == 1:
            return rows
        touched = self._documents(later).groupBy(F.col("key").alias("__k")).agg(F.max("seq").alias("__s"))
        return rows.join(touched, (F.col("key") == F.col("__k")) & (F.col("seq") < F.col("__s")), "left_anti")

    def _stale(self, names: Sequence[str]) -> DataFrame:
        """The bits of the keys that a later part touches, a word a piece, in a row a run and part."""
        touched = self._documents(names).groupBy("key").agg(F.max("seq").alias("newest"), F.collect_list("seq").alias("seqs"))
        stale = touched.where(F.size("seqs") > 1).select("key", "newest", F.explode("seqs").alias("seq")).where("seq < newest")
        piece, bit = F.shiftright("key", _PIECE).bitwiseAND(F.lit((1 << _RUN - _PIECE) - 1)), F.expr("shiftleft(1L, cast(key & 63 as int))")
        words = [F.coalesce(F.bit_or(F.when(piece == i, bit)), F.lit(0).cast("long")) for i in range(1 << _RUN - _PIECE)]
        return stale.groupBy(F.shiftright("key", _RUN).alias("run"), "seq").agg(F.array(*words).alias("stale"))

    def compact(self) -> None:
        """Fold all parts into a base; readers take it from its rename on."""
        if len(self.folder.live()) < 2:
            return
        with self.folder.base() as base, shuffles_released(self.spark):
            at, live, number = base.path, base.live, F.lit(base.number).cast("long")
            # joined where blocks are read, and gone before they move: of these rows there is one for a run, so they are few
            self._stale(live).write.parquet(f"{at}/stale")
            stale = self.spark.read.schema("run long, seq long, stale array<long>").parquet(f"{at}/stale")
            if stale.count() <= _BROADCAST:
                stale = F.broadcast(stale)
            blocks = self._blocks(live)
            for part_of in self._passes(blocks, F.size("keys"), [f"{n}/blocks" for n in live]):
                packed = blocks.where(part_of).join(stale, ["run", "seq"], "left").select("token", "run", "keys", "tfs", "ns", "places", "stale").mapInArrow(_counting_blocks, _PACKED)
                self._write(self._sorted(packed).select("*", number.alias("seq")), f"{at}/blocks")
            self._newest(live).where("n IS NOT NULL").select("key", "n", number.alias("seq")).write.parquet(f"{at}/documents")
            self._read("stats", _STATS, live).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).withColumn("seq", number).write.parquet(f"{at}/stats")
            self.folder.delete(f"{at.rpartition('/')[2]}/stale")

    # -- reading

    def statistics(self) -> DataFrame:
        """One row: documents and tokens."""
        return self._read("stats", _STATS, self.folder.live()).agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))

    def postings(self, wanted: Column, places: bool = True) -> DataFrame:
        """(token, key, tf, n, positions) of counting postings where a condition on ``token`` and ``run`` holds; positions if ``places``."""
        live = self.folder.live()
        return self._counting(self._opened(self._blocks(live).where(wanted), places), live).drop("seq")

    def occurrences(self, terms: Sequence[tx.Term], pieces: Sequence[int] | None = None) -> DataFrame:
        """(key, n, tf0, tf1, ...) of documents that hold any of the terms' words: how often each term occurs. ``pieces``: only their documents."""
        token = F.col("token")
        one = _is
        wanted, columns, phrases = F.lit(False), [], {}
        for i, t in enumerate(terms):
            if len(t.words) == 1:
                wanted = wanted | one(t)
                columns.append(F.coalesce(F.sum(F.when(one(t), F.col("tf"))), F.lit(0)).cast("int").alias(f"tf{i}"))
                continue
            phrases[i] = t.words
            for k, w in enumerate(t.words):
                wanted = wanted | (token == w)
                columns.append(F.first(F.when(token == w, F.col("positions")), True).alias(f"p{i}_{k}"))
        if pieces is not None:
            wanted = wanted & F.col("run").isin(sorted({p >> _RUN - _PIECE for p in pieces}))
        found = self.postings(wanted, bool(phrases))
        if pieces is not None:
            found = found.where(F.shiftright("key", _PIECE).isin(list(pieces)))
        found = found.groupBy("key").agg(F.first("n").alias("n"), *columns)
        for i, words in phrases.items():
            starts = F.col(f"p{i}_0")
            for k in range(1, len(words)):
                starts = F.array_intersect(starts, F.transform(f"p{i}_{k}", _minus(k)))
            found = found.withColumn(f"tf{i}", F.coalesce(F.array_size(starts), F.lit(0)))
        return found.select("key", "n", *[f"tf{i}" for i in range(len(terms))])

    def bm25(self, terms: Sequence[tx.Term], key: str = "id") -> DataFrame:
        """(key, rank) of matching documents; rank is negative and lower is better. The same figures as ``text.bm25`` over the text."""
        if not terms:
            return self.spark.createDataFrame([], f"`{key}` long, rank double")
        found = self.occurrences(terms)
        hit = _any_of(terms)
        df = found.agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"__df{i}") for i in range(len(terms))])
        facts = self.statistics().select(F.col("documents").alias("__n"), (F.col("tokens") / F.col("documents")).alias("__avg")).join(F.broadcast(df))  # one row each
        scored = found.where(hit).join(F.broadcast(facts))
        return scored.select(F.col("key").alias(key), (-tx.bm25_score([F.col(f"tf{i}") for i in range(len(terms))], F.col("n"))).alias("rank"))

    def best(self, terms: Sequence[tx.Term], k: int, key: str = "id") -> DataFrame:
        """(key, rank) of some documents, among which are the k best of ``bm25`` and all that equal the k-th.

        With phrases, or while parts are waiting to be compacted, these are all matching documents.
        """
        live = self.folder.live()
        if not terms or len(live) != 1 or any(len(t.words) > 1 for t in terms):
            return self.bm25(terms, key)
        wanted = _is(terms[0])
        for t in terms[1:]:
            wanted = wanted | _is(t)
        each = F.transform(F.arrays_zip("keys", "tfs", "ns"), lambda p: F.struct(F.shiftright(p["keys"], _PIECE).alias("piece"), p["tfs"].alias("top"), p["ns"].alias("least"), F.call_function("shiftleft", F.lit(1).cast("long"), p["keys"].bitwiseAND(F.lit(63)).cast("int")).alias("bits")))
        heads = F.when(F.size("keys") < _MANY, each).otherwise(F.col("heads"))
        heads = self._blocks(live).where(wanted).select("token", F.inline(heads)).groupBy("piece").agg(
            F.min("least").alias("n"),
            *[F.coalesce(F.sum(F.when(_is(t), F.col("top"))), F.lit(0)).alias(f"tf{i}") for i, t in enumerate(terms)],
            *[F.coalesce(F.bit_or(F.when(_is(t), F.col("bits"))), F.lit(0).cast("long")).alias(f"bits{i}") for i, t in enumerate(terms)],
        )
        # one row: how many documents hold each term
        df = heads.agg(*[F.coalesce(F.sum(F.bit_count(f"bits{i}")), F.lit(0)).alias(f"__df{i}") for i in range(len(terms))])
        facts = self.statistics().select(F.col("documents").alias("__n"), (F.col("tokens") / F.when(F.col("documents") > 0, F.col("documents"))).alias("__avg")).join(df).first().asDict()
        if not facts["__n"]:
            return self.bm25(terms, key)
        score = lambda rows: rows.withColumns({c: F.lit(v) for c, v in facts.items()}).withColumn("__s", tx.bm25_score([F.col(f"tf{i}") for i in range(len(terms))], F.col("n")))
        bounds = score(heads).select("piece", (F.col("__s") * (1 + 1e-9)).alias("bound"))
        first = [r.piece for r in bounds.orderBy(F.desc("bound"), "piece").limit(k).collect()]  # each has a document at least
        if not first:
            return self.bm25(terms, key)
        some = score(self.occurrences(terms, first).where(_any_of(terms)))
        reached = [r[0] for r in some.select("__s").orderBy(F.desc("__s")).limit(k).collect()]
        pieces = bounds.where(F.col("bound") >= (reached[-1] if len(reached) == k else 0.0)).select("piece")
        few = [r.piece for r in pieces.limit(_NAMED + 1).collect()]
        if len(few) <= _NAMED:
            found = self.occurrences(terms, few)
        else:
            found = self.occurrences(terms).withColumn("piece", F.shiftright("key", _PIECE)).join(pieces, "piece", "left_semi")
        return score(found.where(_any_of(terms))).select(F.col("key").alias(key), (-F.col("__s")).alias("rank"))


def _is(t: tx.Term) -> Column:
    """Whether ``token`` is the term's first word."""
    return F.col("token").startswith(t.words[0]) if t.prefix else F.col("token") == t.words[0]


def _any_of(terms: Sequence[tx.Term]) -> Column:
    hit = F.lit(False)
    for i in range(len(terms)):
        hit = hit | (F.col(f"tf{i}") > 0)
    return hit
