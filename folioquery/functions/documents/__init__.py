"""Document processing: HTML to pages, tables, sections, chunks and transcripts.

Greedy packing and markup need state that column expressions cannot hold; these run as plain functions over Arrow
batches, one document at a time, so memory is bounded by a document.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def flat_map(df: DataFrame, work: Callable[[dict], Iterable[dict]], schema: str, batch: int = 256, keys: Sequence[str] = ()) -> DataFrame:
    """Rows to any number of rows, as dictionaries; only the columns that ``df`` has travel to Python.

    With ``keys`` a row whose work fails does not stop the others: it gives one row with its ``keys`` and the failure in ``error``, a column that
    the schema must have; it is null elsewhere.
    """
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # trees of documents hold no cycles: looking through them for some again and again is half of the time of a deep one
        gc.disable()
        try:
            yield from each(batches)
        finally:
            gc.enable()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            gc.collect(1)
            out: list[dict] = []
            for row in got.to_pylist():
                try:
                    out += work(row)
                except Exception as e:
                    if not keys:
                        raise
                    out.append({k: row[k] for k in keys} | {"error": f"{type(e).__name__}: {e}"[:500]})
                if len(out) >= batch:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)

    return df.mapInArrow(go, schema)
