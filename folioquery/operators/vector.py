"""Exact vector search: normalisation, cosine top-k, the latest-version store, and batching of embeddings."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import BEGUN, Folder, WriteConflict

#: Queries and texts to vectors; a plain function of a list of texts.
Embedder = Callable[[list[str]], Sequence[Sequence[float]]]


#: A folder with the store's facts, in the name of an empty file.
_FACTS = "_facts"


class StoreMismatch(ValueError):
    """Vectors of another dimension or model than the store's."""


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def broken(v: Column) -> Column:
    """Whether an element is null, NaN or infinite: such a vector has no direction."""
    return F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def normalize(v: Column) -> Column:
    """To unit length; a zero vector stays, a broken one is null."""
    v = F.when(~broken(v), v.cast("array<double>"))
    return F.element_at(F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))), 1)


def cosine(v: Column, query: Sequence[float]) -> Column:
    """Cosine with a constant vector, in double precision, by built-in array functions; null for a broken vector or one of another length."""
    unit = F.array(*[F.lit(float(x)) for x in _unit(query)])
    v = F.when((F.size(v) == len(query)) & ~broken(v), v.cast("array<double>"))
    dot = F.aggregate(F.zip_with(v, unit, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    return dot / F.when(norm(v) == 0, F.lit(1.0)).otherwise(norm(v))


def _unit(query: Sequence[float]) -> np.ndarray:
    q = np.asarray(query, "float64")
    if not np.isfinite(q).all():
        raise ValueError("the query vector has a null or infinite element")
    return q / (math.sqrt(float(q @ q)) or 1.0)


def scores(df: DataFrame, key: str, vector: str, query: Sequence[float], score: str = "score") -> DataFrame:
    """(key, score) by one product a batch; null vectors, broken ones and those of another length are left out. Equal vectors score equally, wherever
    they stand in a batch (a BLAS product does not promise that), so ties are ties."""
    q = _unit(query)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(batch.num_rows, -1)
                whole = np.isfinite(flat).all(axis=1)  # a null element is NaN here, and Spark would rank NaN first
                flat = flat[whole]
                size = np.sqrt(np.einsum("ij,ij->i", flat, flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(whole)), pa.array(np.einsum("ij,j->i", flat, q) / np.where(size == 0, 1.0, size))], [key, score])

    rows = df.where(F.size(vector) == len(q)).select(key, F.col(vector).cast("array<float>").alias(vector))
    return rows.mapInArrow(multiply, f"`{key}` {df.schema[key].dataType.simpleString()}, `{score}` double")


def top_k(df: DataFrame, key: str, vector: str, query: Sequence[float], k: int, score: str = "score") -> DataFrame:
    """The k most similar rows, best first, ties by key: each task keeps k, so only k rows a task move."""
    return scores(df, key, vector, query, score).orderBy(F.desc(score), F.asc(key)).limit(k)


def latest(df: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """The newest version of each id; a null vector is a tombstone and hides the id. Of rows with equal versions a tombstone wins, then
    the largest vector."""
    value = [c for c in df.columns if c not in (key, version)]
    order = F.struct(version, F.col("vector").isNull(), "vector") if "vector" in value else F.col(version)
    newest = df.groupBy(key).agg(F.max_by(F.struct(*value), order).alias("__v"))
    return newest.select(key, *[F.col(f"__v.{c}").alias(c) for c in value]).where(F.col("vector").isNotNull()) if "vector" in value else newest.select(key, "__v.*")


class VectorStore:
    """Append-only Parquet of (id, version, vector); a tombstone is a row without a vector.

    The first vectors fix the store's dimension and the model that made them. Vectors or queries of another dimension, or a store that is opened for another model,
    raise ``StoreMismatch`` before any row is written or scored.
    """

    def __init__(self, spark, path: str, model: str | None = None):
        self.spark, self.path, self.model = spark, path.rstrip("/"), model
        self._check(None)

    def _facts(self) -> dict | None:
        """{model, dims} of the store, or None before its first vectors."""
        told = [n for n in Folder(self.spark, f"{self.path}/{_FACTS}").names() if n != BEGUN]
        return json.loads(bytes.fromhex(told[0])) if told else None

    def _check(self, dims: int | None) -> None:
        facts = self._facts()
        if facts is None:
            return
        if self.model is not None and facts["model"] not in (None, self.model):
            raise StoreMismatch(f"{self.path} holds vectors of {facts['model']}, not of {self.model}")
        if dims is not None and dims != facts["dims"]:
            raise StoreMismatch(f"{self.path} holds vectors of {facts['dims']} dimensions, not {dims}")

    def _claim(self, dims: int) -> None:
        """Fix the dimension by one exclusive rename; of two writers the one that comes second checks against it."""
        folder = Folder(self.spark, self.path)
        if self._facts() is None:
            stage = folder.begin()
            folder.mark(f"{stage}/{json.dumps({'model': self.model, 'dims': dims}).encode().hex()}")
            try:
                folder.finish(stage, _FACTS)
            except WriteConflict:
                folder.delete(stage)
        self._check(dims)

    def _append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)

    def add(self, rows: DataFrame, version: int) -> None:
        """Rows (id, vector), normalised on write; a null or broken vector is refused, as it would pass for a tombstone."""
        bad = F.col("vector").isNull() | broken(F.col("vector"))
        if rows.where(bad).limit(1).count():
            raise ValueError("a vector is null, or has a null, NaN or infinite element")
        sizes = rows.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
        if sizes[0] is None:
            return
        if sizes[0] != sizes[1]:
            raise StoreMismatch(f"vectors of {sizes[0]} to {sizes[1]} dimensions")
        self._claim(sizes[0])
        self._append(rows.select(F.col("id").cast("long").alias("id"), F.lit(version).cast("long").alias("version"), normalize(F.col("vector")).cast("array<float>").alias("vector")))

    def remove(self, ids: DataFrame, version: int) -> None:
        self._append(ids.select(F.col("id").cast("long").alias("id"), F.lit(version).cast("long").alias("version"), F.lit(None).cast("array<float>").alias("vector")))

    def frame(self) -> DataFrame:
        return latest(self.spark.read.schema("id long, version long, vector array<float>").parquet(self.path))

    def count(self) -> int:
        return self.frame().count()

    def has_id(self, id_: int) -> bool:
        return bool(self.frame().where(F.col("id") == id_).limit(1).count())

    def search(self, query: Sequence[float], k: int, ids: DataFrame | None = None) -> DataFrame:
        self._check(len(query))
        rows = self.frame()
        return top_k(rows if ids is None else rows.join(ids.select("id"), "id", "left_semi"), "id", "vector", query, k)


# ---------------------------------------------------------------- embedding


def split_cached(rows: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their cached vector, rows to embed), matched on the text's SHA-256."""
    keyed = rows.withColumn("sha256", F.sha2("text", 256))
    met = keyed.join(cache.select("sha256", "vector").dropDuplicates(["sha256"]), "sha256", "left")
    return met.where("vector IS NOT NULL"), met.where("vector IS NULL").drop("vector")


def embed(rows: DataFrame, embedder: Embedder, text: str = "text", vector: str = "vector", batch: int = 1000) -> DataFrame:
    """All columns and the text's vector, in batches of at most ``batch`` texts."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch].copy()
                part[vector] = [list(map(float, v)) for v in embedder(part[text].fillna("").tolist())]
                yield part

    return rows.mapInPandas(run, f"{fields}, `{vector}` array<double>")


def pack_greedy(sizes: Sequence[int], budget: int, most: int = 1000) -> list[list[int]]:
    """Positions in order, in batches within a budget and a count; an item above the budget is alone."""
    out: list[list[int]] = []
    total = 0
    for i, n in enumerate(sizes):
        if not out or total + n > budget or len(out[-1]) >= most:
            out.append([])
            total = 0
        out[-1].append(i)
        total += n
    return out


def split_document(sizes: Sequence[int], budget: int = 32_000) -> list[list[int]]:
    """Cut a document's chunks into runs within the context budget, in order."""
    return pack_greedy(sizes, budget, most=len(sizes) or 1)


def contextual_batches(documents: Sequence[Sequence[int]], budget: int = 32_000, per_batch: int = 64_000, most: int = 1000) -> list[list[tuple[int, list[int]]]]:
    """Batches of (document, chunk positions): each part within ``budget``, each batch within ``per_batch``, at most ``most`` parts and chunks."""
    parts = [(d, run, sum(sizes[i] for i in run)) for d, sizes in enumerate(documents) for run in split_document(sizes, budget)]
    out: list[list[tuple[int, list[int]]]] = []
    tokens = chunks = 0
    for d, run, n in parts:
        if not out or tokens + n > per_batch or len(out[-1]) >= most or chunks + len(run) > most:
            out.append([])
            tokens = chunks = 0
        out[-1].append((d, run))
        tokens, chunks = tokens + n, chunks + len(run)
    return out


def merge_parts(batches: Sequence[Sequence[tuple[int, list[int]]]], vectors: Sequence[Sequence[Sequence]], documents: int) -> list[list]:
    """Put vectors of split documents back together, by document and chunk; counts must agree."""
    out: list[dict[int, object]] = [{} for _ in range(documents)]
    for batch, got in zip(batches, vectors, strict=True):
        for (d, run), part in zip(batch, got, strict=True):
            out[d].update(zip(run, part, strict=True))
    return [[d[i] for i in sorted(d)] for d in out]


# ---------------------------------------------------------------- outbox


def outbox_add(outbox: DataFrame, failed: DataFrame) -> DataFrame:
    """Add failed texts (table_name, column_name, row_id, text); one row for each distinct text of a cell stays."""
    rows = failed.withColumn("text_sha256", F.sha2("text", 256)).withColumn("created_at", F.current_timestamp())
    key = ["table_name", "column_name", "row_id", "text_sha256"]
    return outbox.unionByName(rows.select(*outbox.columns).dropDuplicates(key).join(outbox.select(*key), key, "left_anti"))


def outbox_done(outbox: DataFrame, done: DataFrame) -> DataFrame:
    """What is left once ``done`` has been embedded."""
    key = ["table_name", "column_name", "row_id", "text_sha256"]
    return outbox.join(done.select(*key), key, "left_anti")
