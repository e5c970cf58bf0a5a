"""Regex and substring search from an index: trigrams name the rows that can match, and only these are looked at.

Of each text, with letters folded as the predicates fold them, every three bytes in a row are a gram. A posting has a gram, a run of 64 keys
and a bit for each key whose text holds the gram; postings are sorted and range-partitioned by gram, so a search reads the row groups of its grams
alone. What a pattern requires is a tree of literals under "all of" and "one of"; its grams' bits are met and joined accordingly. The
result may name too many rows, never too few, so the predicate itself is applied to what is named. For the same reason an update only adds a
part, and rows that were deleted or have other texts by now cost a look and change no result; ``fold`` brings the parts together.

A pattern without a literal of three ASCII characters has no requirement: then the caller scans.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import BASE, Log, WriteConflict
from .predicates import And, Leaf, Predicate

try:
    from re import _parser as _sre
except ImportError:  # another Python: patterns have no requirement, and are scanned for
    _sre = None

# Characters that match an ASCII letter when case does not matter: Kelvin sign, long s, dotless and dotted i.
_ODD, _PLAIN = "Kſıİ", "ksii"
_POSTING = "gram int, block long, bits long"
#: Grams of a literal that are looked up at most; fewer name more rows.
GRAMS = 12
#: Bytes of text whose grams a task makes at once.
_BYTES = 1 << 20
#: Rows that are named one by one in the scan, and whose keys are sent to all tasks (8 MB); with more the scan looks at all rows.
NAMED, SENT = 1000, 1_000_000
#: Raw postings that one task groups and sorts.
GROUPED = 1 << 21


@dataclass(frozen=True)
class Need:
    """What a text must hold: a literal, or all or one of some needs."""

    kind: str
    parts: tuple

    def grams(self) -> set[int]:
        if self.kind == "literal":
            return set(grams_of(self.parts[0]))
        return set().union(*(p.grams() for p in self.parts))

    def bits(self, of: dict[int, Column]) -> Column:
        each = [of[g] for g in grams_of(self.parts[0])] if self.kind == "literal" else [p.bits(of) for p in self.parts]
        return reduce(lambda a, b: a.bitwiseOR(b) if self.kind == "one" else a.bitwiseAND(b), each)


def grams_of(literal: str) -> list[int]:
    raw = literal.encode()
    found = [raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2] for i in range(len(raw) - 2)]
    step = -(-len(found) // GRAMS)
    return found[::step]


def _all(needs: Sequence[Need | None]) -> Need | None:
    known = [n for n in needs if n is not None]
    return None if not known else known[0] if len(known) == 1 else Need("all", tuple(known))


def _literal(text: str) -> Need | None:
    """The ASCII runs of at least three characters."""
    runs = [r for r in re.split(r"[^\x00-\x7f]", text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))) if len(r) > 2]
    return _all([Need("literal", (r,)) for r in runs])


def need_of_like(pattern: str) -> Need | None:
    """Of a pattern in which % and _ are wildcards and nothing is escaped."""
    return _all([_literal(x) for x in re.split("[%_]", pattern)])


def need_of_regex(pattern: str) -> Need | None:
    if _sre is None:
        return None
    try:
        parsed = _sre.parse(pattern, re.IGNORECASE)
    except (re.error, RecursionError, OverflowError):
        return None
    return _need(parsed, "")[0]


def _need(items, run: str) -> tuple[Need | None, str]:
    """The need of a sequence that follows the literal ``run``, and the literal at its end (which is part of the need already)."""
    found: list[Need | None] = []

    def close() -> None:
        nonlocal run
        found.append(_literal(run))
        run = ""

    for op, value in items:
        name = str(op)
        if name == "LITERAL":
            run += chr(value)
        elif name == "AT":
            continue  # takes no room
        elif name in ("SUBPATTERN", "ATOMIC_GROUP"):
            need, run = _need(value[-1] if name == "SUBPATTERN" else value, run)
            found.append(need)
        elif name == "BRANCH":
            each = [_need(alternative, run)[0] for alternative in value[1]]
            close()
            found.append(Need("one", tuple(each)) if all(each) else None)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            close()
            found.append(_need(value[2], "")[0])
        elif name == "ASSERT":
            close()
            found.append(_need(value[1], "")[0])
        else:
            close()
    last = run
    found.append(_literal(run))
    return _all(found), last


def need_of(p: Predicate | None) -> list[tuple[str, Need]]:
    """(column, need) of the parts that must all hold."""
    if isinstance(p, And):
        return [x for part in p.parts for x in need_of(part)]
    if not isinstance(p, Leaf) or not isinstance(p.value, str):
        return []
    needs = {"regex": need_of_regex, "ilike": need_of_like, "ilike_prefix": need_of_like}
    need = needs[p.op](p.value) if p.op in needs else None
    return [(p.field, need)] if need is not None else []


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, block, bits) of (key, text), once for each gram and block in a slice."""
    for batch in batches:
        text = batch.column("t").cast(pa.large_binary())
        ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        raw = text.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        keys = batch.column("key").to_numpy()
        row = 0
        while row < len(keys):
            stop = max(row + 1, int(np.searchsorted(ends, ends[row] + _BYTES, "right")) - 1)
            seen: list[np.ndarray] = []
            for at in range(int(ends[row]), int(ends[stop]), _BYTES):  # a longer text in pieces
                part = data[at : min(at + _BYTES + 2, int(ends[stop]))].astype(np.int64)
                if len(part) < 3:
                    continue
                gram = part[:-2] << 16 | part[1:-1] << 8 | part[2:]
                place = np.arange(at, at + len(gram))
                of = np.searchsorted(ends, place, "right") - 1
                inside = place + 3 <= ends[of + 1]
                seen.append(np.unique(gram[inside] << 32 | of[inside] - row))
            if seen:
                both = np.unique(np.concatenate(seen))
                gram, key = both >> 32, keys[row + (both & 0xFFFFFFFF)]
                block, bit = key >> 6, np.left_shift(np.uint64(1), (key & 63).astype(np.uint64))
                order = np.lexsort((block, gram))
                gram, block, bit = gram[order], block[order], bit[order]
                first = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (block[1:] != block[:-1])])
                bits = np.bitwise_or.reduceat(bit, first).view(np.int64)
                yield pa.record_batch([pa.array(gram[first].astype(np.int32)), pa.array(block[first]), pa.array(bits)], ["gram", "block", "bits"])
            row = stop


class SubstringIndex:
    """The index of one text column; ``key`` is a long column that identifies a row. Null keys and texts are not indexed."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = Log(spark, self.root)

    @property
    def exists(self) -> bool:
        return bool(self.log.live())

    def _read(self, names: Sequence[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], _POSTING)
        return self.spark.read.schema(_POSTING).parquet(*[f"{self.root}/{n}" for n in names])

    @staticmethod
    def _write(postings: DataFrame, at: str) -> None:
        # a number that grows with the rows: sorted bits are packed so well that ranges by bytes would be large ones in memory
        n = max(postings.sparkSession.sparkContext.defaultParallelism, -(-postings.count() // GROUPED))
        ranged = postings.repartitionByRange(n, "gram", "block").groupBy("gram", "block").agg(F.bit_or("bits").alias("bits"))
        ranged.sortWithinPartitions("gram", "block").write.mode("append").option("parquet.block.size", 1 << 20).parquet(at)

    def update(self, rows: DataFrame, key: str, text: str) -> None:
        """Add rows, or their new texts. The order of parts does not matter, so writers do not conflict."""
        folded = F.translate(F.col(text), string.ascii_uppercase + _ODD, string.ascii_lowercase + _PLAIN)
        some = rows.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("key"), folded.alias("t"))
        cores = self.spark.sparkContext.defaultParallelism
        if some.rdd.getNumPartitions() < cores:  # a small table's few splits would leave cores idle; runs of keys stay together
            some = some.repartition(cores, F.shiftright("key", 6))
        raw = self.log.begin()
        try:  # cutting ranges looks at the rows twice, so texts are cut into grams before
            some.mapInArrow(_postings, _POSTING).write.parquet(f"{self.root}/{raw}/rows")
            with self.log.part(anywhere=True) as part:
                self._write(self.spark.read.schema(_POSTING).parquet(f"{self.root}/{raw}/rows"), part.path)
        finally:
            self.log.delete(raw)

    def fold(self) -> None:
        """Bring all parts together; where another writer has just done so, nothing is to do."""
        if all(n.endswith(BASE) for n in self.log.live()):
            return
        try:
            with self.log.base() as base:
                self._write(self._read(base.live), base.path)
        except WriteConflict:
            pass

    def candidates(self, need: Need) -> DataFrame:
        """(key) of the rows that may hold what is needed."""
        grams = sorted(need.grams())
        of = {g: F.coalesce(F.bit_or(F.when(F.col("gram") == g, F.col("bits"))), F.lit(0).cast("long")) for g in grams}
        blocks = self._read(self.log.live()).where(F.col("gram").isin(grams)).groupBy("block").agg(*[c.alias(f"g{g}") for g, c in of.items()])
        bits = blocks.select("block", need.bits({g: F.col(f"g{g}") for g in grams}).alias("bits")).where("bits <> 0")
        named = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("bits", i) == 1)
        return bits.select("block", F.explode(named).alias("bit")).select((F.col("block") * 64 + F.col("bit")).alias("key"))

    def narrow(self, rows: DataFrame, key: str, need: Need) -> DataFrame:
        """Rows that may hold what is needed: a few are named in the scan, the keys of more are sent to it. Texts are never shuffled: beyond ``SENT`` all rows are looked at."""
        found = self.candidates(need)
        few = [r.key for r in found.limit(NAMED + 1).collect()]
        if len(few) <= NAMED:
            return rows.where(F.col(key).isin(few)) if few else rows.where(F.lit(False))
        if found.limit(SENT + 1).count() > SENT:
            return rows
        return rows.join(F.broadcast(found.withColumnRenamed("key", "__key")), F.col(key).cast("long") == F.col("__key"), "left_semi")
