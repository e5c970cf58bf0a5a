"""Embedding as a stage after a write: what changed is queued, embedded in batches, stored, and what failed goes to the outbox.

    queue = changed_texts(before, after, "id", "text")
    done, failed = flush(queue, embedder, cache)
    store.add(done ...); outbox_add(outbox, failed ...)
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import shared_dir
from .vector import Embedder, contextual_batches, pack_greedy, split_cached

#: Nested lists of a document's chunks to nested lists of vectors.
ContextualEmbedder = Callable[[list[list[str]]], Sequence[Sequence[Sequence[float]]]]
# Token budgets of a request, of a document's context and of a contextual batch, and the most texts in each.
REQUEST, CONTEXT, BATCH, MOST = 1_000_000, 32_000, 64_000, 1000
TOKENS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def changed_texts(before: DataFrame, after: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text) of rows to embed after a write: new ones, and those whose text is another one. Empty and null texts have no vector."""
    old = before.select(F.col(key), F.sha2(F.coalesce(text, F.lit("")), 256).alias("__old"))
    new = after.where(F.btrim(F.col(text)) != "").select(key, text)
    return new.join(old, key, "left").where(F.col("__old").isNull() | (F.col("__old") != F.sha2(text, 256))).select(key, text)


def lost_texts(before: DataFrame, after: DataFrame, key: str, text: str) -> DataFrame:
    """(key) of rows that had a vector and must lose it: deleted ones, and those whose text is gone."""
    has = lambda df: df.where(F.btrim(F.col(text)) != "").select(key)
    return has(before).join(has(after), key, "left_anti")


def _vectors(found: Sequence[Sequence[float]]) -> pa.Array:
    return pa.array([None if v is None else [float(x) for x in v] for v in found], pa.list_(pa.float64()))


def embed_rows(rows: DataFrame, key: str, text: str, embedder: Embedder, budget: int = REQUEST, most: int = MOST) -> DataFrame:
    """(key, text, vector, error): greedy batches within a token budget and a count, each of a task's own rows.

    A batch that fails, or returns another number of vectors than it has texts, leaves its rows without a vector and with the error; the others go on.
    """
    sized = rows.select(F.col(key), F.col(text), F.regexp_count(F.col(text), F.lit(TOKENS)).cast("long").alias("__n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            vectors: list = [None] * len(texts)
            errors: list = [None] * len(texts)
            for part in pack_greedy(batch.column(2).to_pylist(), budget, most):
                try:
                    got = list(embedder([texts[i] for i in part]))
                    if len(got) != len(part):
                        raise ValueError(f"{len(got)} vectors for {len(part)} texts")
                    for i, v in zip(part, got, strict=True):
                        vectors[i] = v
                except Exception as e:
                    for i in part:
                        errors[i] = f"{type(e).__name__}: {e}"[:300]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _vectors(vectors), pa.array(errors, pa.string())], [key, text, "vector", "error"])

    kind = rows.schema[key].dataType.simpleString()
    return sized.mapInArrow(run, f"`{key}` {kind}, `{text}` string, vector array<double>, error string")


def embed_chunks(chunks: DataFrame, document: str, index: str, text: str, embedder: ContextualEmbedder, context: int = CONTEXT, batch: int = BATCH, most: int = MOST) -> DataFrame:
    """(document, index, vector, error): chunks embedded beside the others of their document.

    A batch that fails is sent again document by document, so only documents that fail by themselves get the error. The chunks of a document come together in order; a document above the context budget is cut into runs, and the vectors of its runs
    are put together again. A document's chunks meet in one task, so a document must fit into memory.
    """
    rows = chunks.select(F.col(document).alias("d"), F.col(index).alias("i"), F.coalesce(text, F.lit("")).alias("t"))
    rows = rows.withColumn("n", F.regexp_count("t", F.lit(TOKENS)).cast("long"))
    grouped = rows.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("i", "t", "n"))).alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            documents = got.column(1).to_pylist()
            plan = contextual_batches([[x["n"] for x in c] for c in documents], context, batch, most)
            vectors: list = [[None] * len(c) for c in documents]
            errors: list = [None] * len(documents)

            def send(some: list[tuple[int, list[int]]]) -> None:
                answer = embedder([[documents[d][k]["t"] for k in part] for d, part in some])  # noqa: B023
                if [len(a) for a in answer] != [len(part) for _, part in some]:
                    raise ValueError("the number of vectors is not that of the chunks")
                for (d, part), found in zip(some, answer, strict=True):
                    for k, v in zip(part, found, strict=True):
                        vectors[d][k] = v  # noqa: B023

            for some in plan:
                try:
                    send(some)
                except Exception as e:  # which of them is it? each is sent alone
                    for one in some:
                        try:
                            if len(some) == 1:
                                raise e
                            send([one])
                        except Exception as e1:
                            errors[one[0]] = f"{type(e1).__name__}: {e1}"[:300]
            for d in (d for d, e in enumerate(errors) if e):  # a document has all its vectors or none
                vectors[d] = [None] * len(documents[d])
            sizes = [len(c) for c in documents]
            ids = got.column(0).take(pa.array([k for k, n in enumerate(sizes) for _ in range(n)], pa.int64()))
            at = pa.array([x["i"] for c in documents for x in c], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, at, _vectors([v for c in vectors for v in c]), pa.array([e for e, c in zip(errors, documents, strict=True) for _ in c], pa.string())], ["d", "i", "vector", "error"])

    kind = chunks.schema[document].dataType.simpleString()
    out = grouped.mapInArrow(run, f"d {kind}, i long, vector array<double>, error string")
    return out.select(F.col("d").alias(document), F.col("i").alias(index), "vector", "error")


def flush(queue: DataFrame, key: str, text: str, embedder: Embedder, cache: DataFrame, table: str, column: str, **limits: int) -> tuple[DataFrame, DataFrame]:
    """(done (key, vector), failed rows for the outbox (table_name, column_name, row_id, text)); texts with a cached vector are not sent.

    Equal texts are embedded once. What the embedder answered is written to the shared folder before it is split, so each text is sent once
    and every row of the queue is in exactly one of both results, however often they are read.
    """
    done = F.col("error").isNull()
    rows = embed_stage(queue, key, text, embedder, cache, **limits)
    failed = rows.where(~done).select(F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), "row_id", "text")
    return rows.where(done).select(F.col("row_id").alias(key), "vector"), failed


def embed_stage(queue: DataFrame, key: str, text: str, embedder: Embedder, cache: DataFrame, **limits: int) -> DataFrame:
    """(row_id, text, sha256, vector, error) of a queue, written once to the shared folder; a row has a vector or an error."""
    hit, miss = split_cached(queue.select(F.col(key).alias("row_id"), F.col(text).alias("text")), cache)
    once = miss.groupBy("sha256").agg(F.first("text").alias("text"))
    made = embed_rows(once, "sha256", "text", embedder, **limits)
    made = made.select("sha256", "vector", F.when(F.col("vector").isNull(), F.coalesce("error", F.lit("no vector"))).alias("error"))
    rows = miss.select("row_id", "text", "sha256").join(made, "sha256").unionByName(hit.select("row_id", "text", "sha256", F.col("vector").cast("array<double>").alias("vector"), F.lit(None).cast("string").alias("error")))
    spark = queue.sparkSession
    at = f"{shared_dir(spark)}/embedded-{uuid.uuid4().hex}"
    rows = rows.select("row_id", "text", "sha256", "vector", "error")
    rows.write.parquet(at)
    return spark.read.schema(rows.schema).parquet(at)


def outbox_groups(outbox: DataFrame) -> DataFrame:
    """(table_name, column_name, texts, oldest): what waits for a retry, by the cell it belongs to."""
    return outbox.groupBy("table_name", "column_name").agg(F.count("*").alias("texts"), F.min("created_at").alias("oldest"))
