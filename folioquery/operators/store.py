"""A store: the tables of a catalog below one folder.

The folder holds the catalog that it was made with and a versioned table for each of the catalog's tables. Opening a new folder provisions it; opening an
existing one compares catalogs, so that a program with another schema is refused before it reads or writes a row. ``migrate`` adopts a catalog that
adds tables or nullable fields.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Log, WriteConflict
from .query import Database, Query
from .schema import Catalog, SchemaError
from .writes import VersionedTable


class Store:
    """``root`` is an absolute path or a URI; a store in memory is not offered."""

    def __init__(self, spark: SparkSession, root: str, catalog: Catalog, **parts):
        if not (root.startswith("/") or "://" in root or root.startswith("file:/")):
            raise SchemaError(f"a store needs an absolute path, not {root!r}")
        catalog.validate()
        self.spark, self.root, self.catalog, self.parts = spark, root.rstrip("/"), catalog, parts
        self.log = Log(spark, f"{self.root}/_catalog")
        found = self.stored()
        if found is None:
            found = self._tell(catalog)
        if found.hash() != catalog.hash():
            raise SchemaError(f"{self.root} was made with another catalog; it differs in {', '.join(self.differences(found)) or 'its views'}")
        for t in catalog.tables.values():
            self.table(t.name).provision(t)

    def stored(self) -> Catalog | None:
        """The catalog of the folder, or None where there is no store."""
        live = self.log.live()
        return Catalog.from_dict(json.loads(self.spark.read.text(f"{self.log.root}/{live[0]}/text", wholetext=True).first().value)) if live else None

    def _tell(self, catalog: Catalog) -> Catalog:
        """Write the catalog down; of two programs that create a store, the second takes the first one's."""
        try:
            with self.log.base() as base:
                base.number += 1
                text = json.dumps(catalog.to_dict())
                self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{base.path}/text")
        except WriteConflict:
            pass
        return self.stored()

    def differences(self, other: Catalog) -> list[str]:
        """Names of tables that are not the same in both catalogs."""
        names = sorted({*self.catalog.tables, *other.tables})
        return [n for n in names if self.catalog.tables.get(n) != other.tables.get(n)]

    def table(self, name: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.root}/{self.catalog[name].name}")

    def load(self, name: str) -> DataFrame:
        """The current rows of a table."""
        return self.table(name).read()

    @property
    def database(self) -> Database:
        return Database(self.catalog, self.load, **self.parts)

    def commit(self, name: str, make: Callable[[Query], DataFrame], attempts: int = 5) -> int:
        """Commit what ``make`` returns from a query on the table; after a conflict it is made again. Returns the version."""
        return self.table(name).change(lambda now: make(Database(self.catalog, lambda n: now if n == name else self.load(n), **self.parts).table(name)), attempts)

    @classmethod
    def migrate(cls, spark: SparkSession, root: str, catalog: Catalog, **parts) -> Store:
        """Open an existing store with a catalog that adds tables, or fields that may be null; rows get nulls there. Anything else is refused."""
        log = Log(spark, f"{root.rstrip('/')}/_catalog")
        if not log.live():
            raise SchemaError(f"there is no store at {root}")
        store = cls.__new__(cls)
        store.spark, store.root, store.catalog, store.parts, store.log = spark, root.rstrip("/"), catalog, parts, log
        before = store.stored()
        for t in before.tables.values():
            now = catalog.tables.get(t.name)
            old, new = {f.name: f for f in t.fields}, {f.name: f for f in now.fields} if now else {}
            lost = [n for n in old if new.get(n) != old[n]]
            strict = [n for n, f in new.items() if n not in old and not f.nullable]
            if lost or strict:
                raise SchemaError(f"{t.name}: {', '.join(lost + strict)} cannot change")
            if len(new) > len(old):
                added = [F.lit(None).cast(f.sql_type).alias(n) for n, f in new.items() if n not in old]
                store.table(t.name).change(lambda rows, added=added, names=list(new): rows if set(names) <= set(rows.columns) else rows.select("*", *added).select(*names))
        with log.base() as base:
            base.number += 1
            spark.createDataFrame([(json.dumps(catalog.to_dict()),)], "value string").coalesce(1).write.text(f"{base.path}/text")
        return cls(spark, root, catalog, **parts)
