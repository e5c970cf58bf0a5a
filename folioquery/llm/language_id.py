"""Hierarchical language identification.

Byte 2-, 3- and 4-grams of the whole text (A-Z lower-cased, white space as one kind) are hashed to
``dims`` relative frequencies. One-versus-one linear support vector machines first vote on the language
family, then others, trained on that family alone, on the language within it. All classifiers are columns
of one weight matrix, so prediction is one pass without a shuffle: sums of gathered rows, or, where many machines or a long text would make
these large, a product of blocks of gram frequencies. The matrix is a file in the shared folder that workers map, as it grows with the square of
the number of families.

The model is fitted on a bounded sample: about ``per_language`` documents of each language, chosen by
a hash of doc_id, and held compressed; a machine is fitted on its two classes' rows, which are opened in place for it. Prediction covers every
row and uses the text alone.

Defined cases: a text that is null or has no letter is ``und`` with score 0; without any learned
language every text is ``und``; with one learned language that one is predicted. A null lang never
trains; a null doc_id trains like any other. Ties between votes go to the larger sum of margins, then to the
alphabetically first language. Repeated rows are predicted alike. Input columns are carried through.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kit

# Language codes by family. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi fo",
    "romance": "fr es it pt ro ca gl oc ast la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "finnic": "fi et hu",
    "celtic": "ga gd cy br",
    "turkic": "tr az kk ky uz tk tt",
    "iranian": "fa ku ps tg",
    "indic": "hi ur bn pa gu mr ne si",
    "semitic": "ar he mt am",
    "malayic": "id ms jv su tl",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_ORDERS = (2, 3, 4)
_TABLE = np.where(kit._SPACE, 0x20, kit._LOWER).astype(np.uint8)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def family(code: str) -> str:
    return _FAMILY.get(code.split("-")[0].split("_")[0].lower(), code)


def gram_slots(data: np.ndarray, bounds: np.ndarray, dims: int) -> Iterator[np.ndarray]:
    """For each order the hashed slot of the n-gram at every byte; slot ``dims`` where it would leave its document."""
    x = _TABLE[data].astype(np.uint32)
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(x))
    for n in _ORDERS:
        v = np.zeros(len(x), np.uint32)
        for k in range(n):
            v[: len(x) - k] = (v[: len(x) - k] << np.uint32(8)) | x[k:]
        h = (v ^ (v >> np.uint32(15))) * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        slot = ((h >> np.uint32(8)) % np.uint32(dims)).astype(np.int64)
        slot[left < n] = dims
        yield slot


def has_letter(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether each document has a letter of any script."""
    seen = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
    found = seen[bounds[1:]] > seen[bounds[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(map(str.isalpha, data[bounds[i] : bounds[i + 1]].tobytes().decode()))
    return found


@dataclass
class Machine:
    """One linear classifier: positive margins speak for ``yes``, others for ``no``."""

    yes: str
    no: str
    level: str
    bias: float = 0.0


def fit_svm(yes: np.ndarray, no: np.ndarray, epochs: int = 60, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Linear SVM (squared hinge, L2) by full gradient steps with momentum; the two classes' rows are read in place."""
    n, w, b = len(yes) + len(no), np.zeros(yes.shape[1], np.float32), 0.0
    step = np.zeros_like(w)
    half = np.float32(0.5 / max(1, len(yes))), np.float32(0.5 / max(1, len(no)))
    rate = 1.0 / (2 * float(sum(np.einsum("ij,ij->i", x, x).sum() for x in (yes, no)) / n) + penalty) if n else 0.0
    back = 0.0
    for _ in range(epochs):
        up, down = np.maximum(0, 1 - (yes @ w + b)) * half[0], np.maximum(0, 1 + (no @ w + b)) * half[1]
        step = 0.9 * step + rate * (2 * (up @ yes - down @ no) - penalty * w)
        back = 0.9 * back + rate * 2 * float(up.sum() - down.sum())
        w, b = w + step.astype(np.float32), b + back
    return w, b


#: Bytes of gathered weights up to which sums of rows are taken, and documents in a block of frequencies beyond.
_GATHER, _DOCUMENTS = 32 << 20, 256


@dataclass
class Model:
    languages: list[str]
    machines: list[Machine]
    dims: int
    #: File of the weights, dims x machines.
    weights: str | None = None

    @cached_property
    def table(self) -> np.ndarray:
        """The weights and a row of zeros, read once a worker; rows that no text asks for stay on disk."""
        stored = kit.map_file(self.weights, "<f4", 0, (self.dims + 1) * len(self.machines))
        if not isinstance(stored, np.ndarray):
            stored = stored.take(np.arange(len(stored)))
        return stored.reshape(self.dims + 1, -1)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "table"}

    def margins(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(documents, machines) margins over whole texts."""
        n = len(bounds) - 1
        total, count = np.zeros((n, len(self.machines)), np.float64), np.zeros(n)
        if not len(data) or not self.machines:
            return total
        real = np.flatnonzero(np.diff(bounds))
        wide = 4 * len(data) * len(self.machines) > _GATHER
        seen = [slot.astype(np.int32) if wide else slot for slot in gram_slots(data, bounds, self.dims)]
        for slot in seen:
            count[real] += np.add.reduceat((slot < self.dims).astype(np.int64), bounds[real])
            if not wide:
                total[real] += np.add.reduceat(self.table[slot], bounds[real], axis=0)
        for lo in range(0, n if wide else 0, _DOCUMENTS):
            some = bounds[lo : lo + _DOCUMENTS + 1]
            grams = np.zeros((len(some) - 1, self.dims + 1), np.float32)
            for slot in seen:
                for k, (a, b) in enumerate(zip(some[:-1].tolist(), some[1:].tolist(), strict=True)):
                    grams[k] += np.bincount(slot[a:b], minlength=self.dims + 1)
            total[lo : lo + len(grams)] = grams @ self.table
        return total / np.maximum(count, 1)[:, None] + np.array([m.bias for m in self.machines])

    def _vote(self, margins: np.ndarray, level: str, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The winner's index and its mean logistic support."""
        if len(names) == 1:
            return np.zeros(len(margins), np.int64), np.ones(len(margins))
        wins, sums, trust = (np.zeros((len(margins), len(names))) for _ in range(3))
        for k, m in enumerate(self.machines):
            if m.level == level:
                g, a, b = margins[:, k], names.index(m.yes), names.index(m.no)
                p = 1 / (1 + np.exp(-np.clip(4 * g, -40, 40)))
                wins[:, a] += g > 0
                wins[:, b] += g <= 0
                sums[:, a] += g
                sums[:, b] -= g
                trust[:, a] += p
                trust[:, b] += 1 - p
        best = np.argmax(wins + np.tanh(sums) * 0.25, axis=1)
        return best, trust[np.arange(len(best)), best] / (len(names) - 1)

    def predict(self, data: np.ndarray, bounds: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(bounds) - 1
        if not self.languages or not n:
            return ["und"] * n, np.zeros(n)
        letters = has_letter(data, bounds)
        margins = self.margins(data, bounds)
        groups: dict[str, list[str]] = {}
        for code in self.languages:
            groups.setdefault(family(code), []).append(code)
        kin = sorted(groups)
        at, score = self._vote(margins, "", kin)
        out = np.empty(n, object)
        for k, name in enumerate(kin):
            rows = np.flatnonzero(at == k)
            which, trust = self._vote(margins[rows], name, groups[name])
            out[rows] = np.array(groups[name], object)[which]
            score[rows] *= trust
        out[~letters], score[~letters] = "und", 0.0
        return out.tolist(), score


def _by_language(of: dict[str, int]) -> Column:
    return F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(v)) for k, v in of.items()))[F.col("lang")]


def _last_hashes(rows: DataFrame, counts: dict[str, int], most: int) -> dict[str, int]:
    """The ``most``-th smallest distinct hash of each language (its largest, if it has fewer) from (lang, h)."""
    whole = {k: 2**63 - 1 for k in counts}
    place = Window.partitionBy("lang").orderBy("h")

    def found(bound: dict[str, int]) -> dict[str, tuple[int, int]]:
        some = rows.where(F.col("lang").isin(*bound) & (F.col("h") <= _by_language(bound))).distinct()
        first = some.withColumn("k", F.row_number().over(place)).where(F.col("k") <= most)
        return {r[0]: (r[1], r[2]) for r in first.groupBy("lang").agg(F.max("h"), F.max("k")).collect()}

    # some four times as many hashes as are needed; where many documents are equal, and so these are too few, all of them
    got = found({k: kit.hash_bound((4 * most + 64) / n) for k, n in counts.items()})
    short = {k: whole[k] for k, n in counts.items() if got.get(k, (0, 0))[1] < most and n > 4 * most + 64}
    return {k: x for k, (x, _) in (got | (found(short) if short else {})).items()}


def train(docs: DataFrame, usable: Column | None = None, per_language: int = 500, dims: int = 1 << 13) -> Model:
    """Fit on at most ``per_language`` documents of each language where ``usable`` holds.

    ``docs`` needs doc_id, text and lang. The sample is exact whatever the ids are: of each language the documents with the smallest hashes of
    id and text, equal ones once.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows if usable is None else rows.where(usable)
    text = F.col("text").cast("string")
    rows = rows.select(text.alias("text"), F.col("lang").cast("string").alias("lang"), F.xxhash64(F.col("doc_id").cast("long"), text, F.lit(17)).alias("h"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model([], [], dims)
    last = _last_hashes(rows.select("lang", "h"), counts, per_language)
    chosen = rows.where(F.col("h") <= _by_language(last)).groupBy("lang", "h").agg(F.first("text").alias("text"))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            out = []
            for _, _, data, bounds in kit.slices(batch.column(0)):
                slots, letters = list(gram_slots(data, bounds, dims)), has_letter(data, bounds)
                for i in range(len(bounds) - 1):
                    x = np.zeros(dims + 1, np.float32)
                    for slot in slots:
                        x += np.bincount(slot[bounds[i] : bounds[i + 1]], minlength=dims + 1)
                    out.append(squeeze.compress((x[:-1] / max(1.0, x[:-1].sum())).astype("<f4").tobytes()) if letters[i] else None)
            yield pa.RecordBatch.from_arrays([batch.column(1), kit.binaries(out)], ["lang", "x"])

    got = chosen.select("text", "lang").transform(kit.mapping, grams, "lang string, x binary").where("x IS NOT NULL").collect()  # the bounded sample
    if not got:
        return Model([], [], dims)
    sample: dict[str, list[bytes]] = {}
    for code, x in sorted((r[0], bytes(r[1])) for r in got):
        sample.setdefault(code, []).append(x)
    del got
    return _fit(docs.sparkSession, sample, dims)


def _opened(sample: dict[str, list[bytes]], codes: list[str], out: np.ndarray) -> np.ndarray:
    """The rows of some languages, in the first rows of ``out``."""
    open_, n = zstandard.ZstdDecompressor(), 0
    for code in codes:
        for x in sample[code]:
            out[n] = np.frombuffer(open_.decompress(x), "<f4")
            n += 1
    return out[:n]


def _fit(spark: SparkSession, sample: dict[str, list[bytes]], dims: int) -> Model:
    """Machines on the rows of two classes at a time; only these are open."""
    languages = sorted(sample)
    families: dict[str, list[str]] = {}
    for code in languages:
        families.setdefault(family(code), []).append(code)
    size = lambda codes: sum(len(sample[c]) for c in codes)
    most = sorted((size(codes) for codes in families.values()), reverse=True)
    room = np.empty((max(sum(most[:2]), most[0]), dims), np.float32)  # the two largest families
    total, square = np.zeros(dims), np.zeros(dims)
    for code in languages:
        total += _opened(sample, [code], room).sum(0, dtype=np.float64)
    mean = (total / size(languages)).astype(np.float32)
    for code in languages:
        x = _opened(sample, [code], room)
        x -= mean
        square += np.einsum("ij,ij->j", x, x)
    spread = (np.sqrt(square / size(languages)) + 1e-4).astype(np.float32) * np.float32(np.sqrt(dims))
    machines: list[Machine] = []
    pairs = [("", a, b, families[a], families[b]) for a, b in itertools.combinations(sorted(families), 2)]
    pairs += [(name, a, b, [a], [b]) for name in sorted(families) for a, b in itertools.combinations(families[name], 2)]
    table = np.zeros((dims + 1, len(pairs)), "<f4")
    for k, (level, a, b, some, others) in enumerate(pairs):
        n = len(_opened(sample, some, room))
        both = room[: n + len(_opened(sample, others, room[n:]))]
        both -= mean
        both /= spread
        w, bias = fit_svm(both[:n], both[n:])
        table[:-1, k] = w / spread
        machines.append(Machine(a, b, level, bias - float(table[:-1, k] @ mean)))
    at = f"{kit.shared_dir(spark)}/language-weights-{uuid.uuid4().hex}"
    kit.put_file(at, table.tobytes())
    return Model(languages, machines, dims, at)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs``, then ``lang_pred`` and ``score``; where these names clash, the input's come first."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    text_at = [c.lower() for c in docs.columns].index("text")
    kit.bound_batches(docs.sparkSession)
    kept = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, scores = [], [np.zeros(0)]
            for _, _, data, bounds in kit.slices(batch.column(text_at)):
                c, s = kept.value.predict(data, bounds)
                codes += c
                scores.append(s)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.string()), pa.array(np.concatenate(scores), pa.float64())], [*names, "__lang", "__score"])

    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True))
    return docs.toDF(*names).transform(kit.mapping, label, f"{kinds}, __lang string, __score double").toDF(*docs.columns, "lang_pred", "score")
