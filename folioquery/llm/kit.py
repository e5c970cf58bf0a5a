"""Shared pieces of the corpus operators: vectorised words and hashes over Arrow strings, and shared storage.

Words are maximal runs of bytes other than ``\\x20 \\x09-\\x0D``. UTF-8 keeps every byte of a
non-ASCII character above 0x7F, so byte work never cuts a character.
"""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k bytes of a little-endian block
_BASE, _BASE2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Bytes of text handled at once, so that the 8-byte arrays beside them stay small.
SLICE_BYTES = 1 << 18
#: Rows of text in an Arrow batch, so that a batch and its copy in the JVM stay small.
BATCH_ROWS = 2000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i in 0..n."""
    if base not in _POWERS or len(_POWERS[base][0]) <= n:
        size = max(n + 1, 1 << 16)
        up = np.full(size, base, U64)
        down = np.full(size, pow(base, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        _POWERS[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[base]


def block_keys(seed: int, k: np.ndarray) -> np.ndarray:
    """The key that the k-th block of a string is scrambled with."""
    with np.errstate(over="ignore"):
        return mix(U64(seed) + k.astype(U64) * U64(0xA24BAED4963EE407))


def string_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = _BASE) -> np.ndarray:
    """Hashes of the byte strings [start, end): each 8-byte block is scrambled with a key of its place, then the blocks add up.

    Scrambling is not linear, so no pattern of text collides by algebra, whatever its length; strings of up to 8 bytes and equal length
    never collide. Strings of one hash differ with a chance of 2**-64 a pair; a second seed gives an independent hash.
    """
    size = end - start
    out = np.zeros(len(size), U64)
    if not len(size):
        return out
    raw = np.zeros(len(data) + 8, np.uint8)
    raw[: len(data)] = data
    block = np.ndarray((len(data) + 1,), "<u8", raw, strides=(1,))  # the 8 bytes from every place on

    def part(at: np.ndarray, left: np.ndarray, key) -> np.ndarray:
        return mix((block[at] & _KEEP[np.minimum(left, 8)]) ^ key)

    keys = block_keys(seed, np.arange(4))
    out = part(start, size, keys[0])
    rows = np.flatnonzero(size > 8)
    with np.errstate(over="ignore"):
        for k in (1, 2, 3):
            if not len(rows):
                break
            out[rows] += part(start[rows] + 8 * k, size[rows] - 8 * k, keys[k])
            rows = rows[size[rows] > 8 * (k + 1)]
        if len(rows):  # all further blocks of long strings at once
            many = (size[rows] - 25) // 8
            k = ragged(np.full(len(rows), 4), many)
            at, left = np.repeat(start[rows], many) + 8 * k, np.repeat(size[rows], many) - 8 * k
            out[rows] += np.add.reduceat(part(at, left, block_keys(seed, k)), np.cumsum(many) - many)
        return mix(out + size.astype(U64) * U64(0xA24BAED4963EE407))


def order_of(keys: np.ndarray, bits: int = 64) -> np.ndarray:
    """What sorts keys below 2**bits. The row number goes into the low bits and plain values are sorted, which is several times faster than
    sorting row numbers; where both do not fit, rows that differ in the bits left out alone are put right afterwards."""
    n = len(keys)
    low = max(1, (n - 1).bit_length()) if n else 0
    number = np.arange(n, dtype=np.uint64)
    exact = bits + low <= 64
    packed = (keys.astype(np.uint64) << U64(low) if exact else keys >> U64(low) << U64(low)) | number
    packed.sort()
    order = (packed & U64((1 << low) - 1)).astype(np.int64)
    if exact:
        return order
    for _ in range(4):
        sorted_ = keys[order]
        wrong = np.flatnonzero(sorted_[1:] < sorted_[:-1])
        if not len(wrong):
            return order
        wrong = wrong[np.r_[True, np.diff(wrong) > 1]]
        order[wrong], order[wrong + 1] = order[wrong + 1], order[wrong]
    return np.argsort(keys)


def distinct(keys: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the number of each key among them."""
    order = order_of(keys, bits)
    sorted_ = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(new) - 1
    return sorted_[new], at


def equal_strings(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, size: np.ndarray) -> bool:
    """Whether a[at_a : at_a + size] is b[at_b : at_b + size] for every row; bytes are compared 8 at a time."""
    tail = np.zeros(8, np.uint8)
    left, right = (np.ndarray((len(x) + 1,), "<u8", np.concatenate([x, tail]), strides=(1,)) for x in (a, b))
    done = 0
    while len(size):
        if done == 32:  # what is left of long strings at once
            many = size - done
            return bool((a[ragged(at_a + done, many)] == b[ragged(at_b + done, many)]).all())
        keep = _KEEP[np.minimum(size - done, 8)]
        if ((left[at_a + done] ^ right[at_b + done]) & keep).any():
            return False
        done += 8
        rows = np.flatnonzero(size > done)
        at_a, at_b, size = at_a[rows], at_b[rows], size[rows]
    return True


class Spans:
    """Polynomial prefix hashes over a sequence of 64-bit hashes; any span's hash in constant time.

    For runs of a few words, whose hashes are scrambled already. Long runs of a regular pattern lose bits modulo 2**64, so they need a look at
    the words themselves; strings go through ``string_hashes``.
    """

    def __init__(self, values: np.ndarray, base: int = _BASE):
        self.base = base
        up, self._down = _powers(base, len(values))
        self._sum = np.zeros(len(values) + 1, U64)
        np.cumsum(values * up[: len(values)], out=self._sum[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the spans [start, end), scrambled and length-aware."""
        h = (self._sum[end] - self._sum[start]) * self._down[start]
        return mix(h + (end - start).astype(U64) * U64(0xA24BAED4963EE407))


class Words:
    """The words of a run of documents: byte offsets, word counts and lazily computed hashes."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        self.bounds = bounds
        solid = ~_SPACE[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[bounds] = True
        before = np.empty(len(data), bool)
        after = np.empty(len(data), bool)
        if len(data):
            before[0] = after[-1] = True
            before[1:] = ~solid[:-1]
            after[:-1] = ~solid[1:]
        self.start = np.flatnonzero(solid & (before | cut[:-1]))
        self.end = np.flatnonzero(solid & (after | cut[1:])) + 1
        #: Word number at which each document starts, with the total last.
        self.first = np.searchsorted(self.start, bounds)
        self._hashes: dict[int, np.ndarray] = {}

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, seed: int = _BASE) -> np.ndarray:
        if seed not in self._hashes:
            self._hashes[seed] = string_hashes(self.data, self.start, self.end, seed)
        return self._hashes[seed]

    def packed(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The words joined by single spaces, and each word's start and end in that string."""
        size = self.end - self.start
        end = np.cumsum(size + 1) - 1
        out = np.full(int(end[-1]) if len(end) else 0, 0x20, np.uint8)
        out[ragged(end - size, size)] = self.data[ragged(self.start, size)]
        return out.tobytes(), end - size, end


def text_arrays(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a string column; a null counts as an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def slices(col: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, bounds) of runs of whole documents; only a single longer document exceeds ``most``."""
    data, bounds = text_arrays(col)
    row, n = 0, len(bounds) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + most, "right")) - 1)
        stop = min(stop, n)
        yield row, stop, data[bounds[row] : bounds[stop]], bounds[row : stop + 1] - bounds[row]
        row = stop


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices start[i] .. start[i] + size[i] - 1 of all i, one after the other."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(start - (np.cumsum(size) - size), size)
    return np.arange(total) + shift


def ints(col: pa.Array, null: int) -> np.ndarray:
    """A long column as numpy, with ``null`` for nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.int64())
    return (col.fill_null(null) if col.null_count else col).to_numpy(zero_copy_only=False)


def binaries(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def crc_text(column: str) -> Column:
    """crc32 of an id written as text."""
    return F.crc32(F.col(column).cast("string"))


def hash_bound(share: float) -> int:
    """The bound that a share of all 64-bit hashes, as Spark's signed longs, do not exceed."""
    return min(2**63 - 1, -(2**63) + int(2**64 * share))


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS`` rows; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def release() -> None:
    """Give freed memory back to the system: Python workers stay alive between tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_libc(), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _libc():
    try:
        return ctypes.CDLL(None)
    except OSError:
        return None


def mapping(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` whose tasks release their memory at the end; for ``DataFrame.transform``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Cut the lineage: write the rows as a table in the shared folder and read them back.

    The driver then collects garbage: what the rows came from is no longer needed, and Spark removes shuffle files and broadcasts
    only once their handles are collected.
    """
    spark, schema = df.sparkSession, df.schema
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(at)
    del df  # else its shuffle files stay in use
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(at)


def local_path(uri: str) -> str | None:
    """The mount path of a shared folder, or None where only a file system client reaches it."""
    if uri.startswith("file:"):
        return "/" + uri.removeprefix("file:").lstrip("/")
    return uri if uri.startswith("/") else None


def put_file(uri: str, content: bytes) -> None:
    """Write a file whole: a temporary name, then a rename, so that retried tasks leave one complete copy."""
    path = local_path(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as f:
            f.write(content)
        os.replace(part, path)
        return
    from pyarrow import fs

    files, at = fs.FileSystem.from_uri(uri)
    files.create_dir(os.path.dirname(at), recursive=True)
    part = f"{at}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(part) as f:
        f.write(content)
    files.move(part, at)


class Paged:
    """An array in a file that only a file system client reaches: pages are read as they are asked for, and the last ones kept."""

    PAGE = 1 << 16
    KEPT = 1024
    _pages: OrderedDict[tuple, bytes] = OrderedDict()

    def __init__(self, uri: str, dtype, offset: int, count: int):
        self.uri, self.dtype, self.offset, self.count = uri, np.dtype(dtype), offset, count

    def __len__(self) -> int:
        return self.count

    def _read(self, pages: list[int]) -> Iterator[bytes]:
        file = None
        for p in pages:
            if (self.uri, p) not in self._pages:
                if file is None:
                    from pyarrow import fs

                    files, at = fs.FileSystem.from_uri(self.uri)
                    file = files.open_input_file(at)
                self._pages[self.uri, p] = file.read_at(self.PAGE, p * self.PAGE)
                if len(self._pages) > self.KEPT:
                    self._pages.popitem(last=False)
            yield self._pages[self.uri, p]

    def take(self, at) -> np.ndarray:
        at = np.asarray(at, np.int64)
        width = self.dtype.itemsize
        byte = self.offset + at.reshape(-1) * width
        out = np.zeros(len(byte) * width, np.uint8)
        each = (byte[:, None] + np.arange(width)).reshape(-1)
        pages, back = np.unique(each // self.PAGE, return_inverse=True)
        order = np.argsort(back, kind="stable")
        edge = np.searchsorted(back[order], np.arange(len(pages) + 1))
        for k, page in enumerate(self._read(pages.tolist())):
            rows = order[edge[k] : edge[k + 1]]
            out[rows] = np.frombuffer(page, np.uint8)[each[rows] % self.PAGE]
        return out.view(self.dtype).reshape(at.shape)


def map_file(uri: str, dtype, offset: int, count: int) -> np.ndarray | Paged:
    """``count`` values of a file from a byte on, for ``take``: memory-mapped where the shared folder is mounted, else read by the page."""
    if not count:
        return np.zeros(0, dtype)
    path = local_path(uri)
    return np.memmap(path, dtype, "r", offset, (count,)) if path is not None else Paged(uri, dtype, offset, count)


def search_sorted(array: np.ndarray | Paged, n: int, wanted: np.ndarray) -> np.ndarray:
    """``np.searchsorted`` that reads only what it compares."""
    if isinstance(array, np.ndarray):
        return np.searchsorted(array, wanted)
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), n)
    for _ in range(int(n).bit_length()):
        middle = (low + high) >> 1
        less = (array.take(np.minimum(middle, n - 1)) < wanted) & (low < high)
        low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
    return low
