"""Tables of many files in which a change rewrites only the files that can hold its keys.

Rows lie in files by ranges of their key, and the table's directory has each file's smallest and largest key. An upsert, an update by key or a delete by key looks up
which ranges its keys fall into, reads those files alone, applies the change, and commits a new directory in which they are replaced; all other files stay as they
are, and belong to both versions. New keys beyond all ranges go to files of their own. A version is a directory (a row a file), committed by exclusive rename, so
two writers of one state conflict, the later one redoes its change, and readers see whole versions.

The change itself is the plain DataFrame operation of ``writes``, on the files it touches. Files that no version in the last hours refers to go with ``vacuum``.
"""

from __future__ import annotations

import bisect
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import BASE, GRACE_HOURS, Log, again
from . import writes

_FILE = "file string, low {k}, high {k}, n long"
#: Keys of a change that are looked up one by one in the directory; of more, ranges are.
NAMED = 10_000


class KeyedTable:
    """Rows with a key that can be ordered and is not null; ``per_file`` rows go into a file on average."""

    def __init__(self, spark: SparkSession, root: str, key: str, per_file: int = 1_000_000):
        self.spark, self.root, self.key, self.per_file = spark, root.rstrip("/"), key, per_file
        self.log = Log(spark, f"{self.root}/directory")
        self.data = Log(spark, f"{self.root}/rows")

    # -- reading

    def _directory(self, live: list[str] | None = None) -> DataFrame | None:
        """(file, low, high, n) of the current version."""
        live = self.log.live() if live is None else live
        return self.spark.read.parquet(f"{self.log.root}/{live[0]}/files") if live else None

    def _rows(self, files: list[str], schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.data.root}/{f}" for f in files]) if files else self.spark.createDataFrame([], schema)

    @property
    def schema(self):
        """The rows' columns, from any file."""
        first = self._directory().select("file").first()
        if first is None:
            return self.spark.read.parquet(f"{self.log.root}/{self.log.live()[0]}/empty").schema
        return self.spark.read.parquet(f"{self.data.root}/{first.file}").schema

    def read(self) -> DataFrame:
        return self._rows([r.file for r in self._directory().select("file").collect()], self.schema)

    def fetch(self, keys: list) -> DataFrame:
        """Rows by key, from the files that can hold them."""
        given = self.spark.createDataFrame([(k,) for k in keys], [self.key]) if keys else None
        files = self._touched(given)[0] if keys else []
        return self._rows(files, self.schema).where(F.col(self.key).isin(list(keys)))

    # -- writing

    def create(self, rows: DataFrame) -> None:
        """The first version, or a new one of these rows alone."""
        with self.log.base() as base:
            base.number += 1
            self._store(rows, base.path, None)

    def _touched(self, changes: DataFrame, live: list[str] | None = None) -> tuple[list[str], list]:
        """Names of the files whose range holds a key of the change, and the directory's other rows."""
        keys = changes.select(F.col(self.key).alias("k")).where("k IS NOT NULL").distinct()
        few = [r.k for r in keys.limit(NAMED + 1).collect()]
        spans = sorted((k, k) for k in few)
        if len(few) > NAMED:  # ranges that hold them all: some more files may be touched, never fewer
            ranged = keys.repartitionByRange(NAMED // 10, "k").groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("low"), F.max("k").alias("high"))
            spans = sorted((r.low, r.high) for r in ranged.collect())
        starts = [low for low, _ in spans]
        rows = self._directory(live).collect()  # a row a file

        def hit(r) -> bool:
            """Spans do not overlap, so the last one that begins within or before the file decides."""
            at = bisect.bisect_right(starts, r.high) - 1
            return at >= 0 and spans[at][1] >= r.low

        return [r.file for r in rows if hit(r)], [r for r in rows if not hit(r)]

    def _store(self, rows: DataFrame, at: str, kept: list | None) -> None:
        """Write rows as files by key ranges, and the directory of these and the kept files."""
        part = f"part-{uuid.uuid4().hex}"
        count = rows.count()
        files = max(1, -(-count // self.per_file))
        where = f"{self.data.root}/{part}"
        rows.repartitionByRange(files, self.key).sortWithinPartitions(self.key).write.parquet(where)
        kind = rows.schema[self.key].dataType.simpleString()
        rows.limit(0).write.parquet(f"{at}/empty")
        name = F.concat(F.lit(f"{part}/"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
        stored = self.spark.read.schema(rows.schema).parquet(where).select(F.col(self.key).alias("k"), name.alias("file"))
        fresh = stored.groupBy("file").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.count("*").alias("n"))
        old = self.spark.createDataFrame([(r.file, r.low, r.high, r.n) for r in kept or []], _FILE.format(k=kind))
        fresh.unionByName(old).coalesce(1).write.parquet(f"{at}/files")

    def _change(self, changes: DataFrame, make: Callable[[DataFrame, DataFrame], DataFrame], attempts: int) -> list[str]:
        """Replace the files that can hold the changed keys; returns their names."""

        def once() -> list[str]:
            with self.log.base() as base:
                base.number += 1
                files, others = self._touched(changes, base.live)
                schema = self.schema
                self._store(make(self._rows(files, schema), changes), base.path, others)
            return files

        return again(once, attempts)

    def upsert(self, rows: DataFrame, keep: tuple[str, ...] = ("created_at",), attempts: int = 5) -> list[str]:
        """Insert rows or overwrite the columns given, as ``writes.upsert``. Rows without a key are refused."""
        if rows.where(F.col(self.key).isNull()).limit(1).count():
            raise ValueError(f"{self.key} is null")
        return self._change(rows, lambda old, new: writes.upsert(old, new, [self.key], keep), attempts)

    def upsert_partial(self, rows: DataFrame, attempts: int = 5) -> list[str]:
        """Change rows that exist; unknown keys change nothing."""
        return self._change(rows, lambda old, new: writes.upsert_partial(old, new, self.key), attempts)

    def delete(self, keys: DataFrame, attempts: int = 5) -> list[str]:
        """Without the rows of these keys."""
        return self._change(keys.select(self.key), lambda old, new: old.join(new.distinct(), self.key, "left_anti").select(*old.columns), attempts)

    def vacuum(self, hours: float = GRACE_HOURS) -> list[str]:
        """Remove parts that no version refers to and no change has touched for some hours; returns their names."""
        self.log.clean(hours)
        versions = self.log.begun([n for n in self.log.names() if n.endswith(BASE)])
        used = {r.part for v in versions for r in self._directory([v]).select(F.split("file", "/")[0].alias("part")).distinct().collect()}
        gone = self.data.older([n for n in self.data.names() if n.startswith("part-") and n not in used], hours)
        for n in gone:
            self.data.delete(n)
        return gone
