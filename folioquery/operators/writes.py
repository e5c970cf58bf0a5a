"""Writes as DataFrame transformations, and versioned Parquet tables to hold their results.

Parquet has no MERGE: an upsert is a full outer join on the conflict key. A new version is written beside the old
one and becomes current by one rename, so readers never see half a write and no path is overwritten while read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import BASE, TAKEN_DAYS, Folder, Log, WriteConflict, again
from .schema import Catalog, SchemaError, TableSpec, check_constraints, split_valid


def _now() -> Column:
    return F.current_timestamp()


def _default(spec: TableSpec, name: str) -> Column:
    f = spec[name]
    if f.default is None:
        return F.lit(None).cast(f.sql_type)
    return _now() if f.default == "CURRENT_TIMESTAMP" else F.lit(f.default).cast(f.sql_type)


def allocate_ids(rows: DataFrame, target: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Consecutive keys after the largest one. Ranks come from per-bucket counts, so no single task orders all rows; there are as many buckets
    as shuffle partitions."""
    top = target.agg(F.coalesce(F.max(key), F.lit(0)).alias("__top"))
    many = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    buckets = rows.withColumn("__b", F.expr(f"pmod(xxhash64({', '.join(order)}), {many})"))
    sizes = buckets.groupBy("__b").agg(F.count("*").alias("__n"))  # one row a bucket
    before = W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    ranked = buckets.withColumn("__r", F.row_number().over(W.partitionBy("__b").orderBy(*order)))
    out = ranked.join(F.broadcast(starts), "__b").join(F.broadcast(top))
    return out.withColumn(key, F.col("__top") + F.col("__from") + F.col("__r")).drop("__b", "__r", "__from", "__top")


def insert(target: DataFrame, rows: DataFrame, spec: TableSpec, order: list[str] | None = None) -> DataFrame:
    """Append validated rows: defaults filled, keys allocated; a given key is refused."""
    key = spec.key.name
    if key in rows.columns and spec.key.kind == "serial":
        raise SchemaError(f"{spec.name}.{key} is allocated, not given")
    good, bad = split_valid(rows, spec)
    if bad.limit(1).count():
        check_constraints(rows, spec)
    full = good.select(*good.columns, *[_default(spec, f.name).alias(f.name) for f in spec.fields if f.name not in good.columns and not f.primary])
    full = allocate_ids(full, target, key, order or rows.columns)
    return target.unionByName(full.select(*target.columns))


def update_where(target: DataFrame, changes: dict[str, Any], predicate: Column, spec: TableSpec | None = None) -> DataFrame:
    """Set columns where the predicate is true; columns that touch on update are set too. The key cannot change."""
    changes = {k: v if isinstance(v, Column) else F.lit(v) for k, v in changes.items()}
    if spec:
        if spec.key.name in changes:
            raise SchemaError("a primary key cannot be updated")
        for name in changes:
            spec[name]
        changes |= {f.name: _now() for f in spec.fields if f.auto_update and f.name not in changes}
    hit = F.coalesce(predicate, F.lit(False))
    return target.select(*[F.when(hit, changes[c].cast(target.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in target.columns])


def delete_where(target: DataFrame, predicate: Column) -> DataFrame:
    """Keep rows where the predicate is false or unknown."""
    return target.where(~F.coalesce(predicate, F.lit(False)))


def delete_cascade(catalog: Catalog, tables: dict[str, DataFrame], name: str, predicate: Column) -> dict[str, DataFrame]:
    """Delete rows and, through cascading foreign keys, what refers to them; returns the tables that changed."""
    gone = {name: tables[name].where(F.coalesce(predicate, F.lit(False))).select(catalog[name].key.name)}
    out = {name: delete_where(tables[name], predicate)}
    todo = [name]
    while todo:
        parent = todo.pop(0)
        for child in catalog.tables.values():
            for f in child.fields:
                if f.references and f.references.split(".")[0] == parent and f.on_delete == "CASCADE" and child.name in tables:
                    keys = gone[parent].select(F.col(catalog[parent].key.name).alias("__gone"))
                    now = out.get(child.name, tables[child.name])
                    lost = now.join(keys, F.col(f.name) == F.col("__gone"), "left_semi").select(child.key.name)
                    out[child.name] = now.join(keys, F.col(f.name) == F.col("__gone"), "left_anti")
                    gone[child.name] = gone[child.name].unionByName(lost) if child.name in gone else lost
                    if child.name not in todo:
                        todo.append(child.name)
    return out


def check_conflict_key(spec: TableSpec, key: tuple[str, ...]) -> None:
    """One column must be a key or unique; several must be a declared unique tuple, in order."""
    if tuple(key) not in spec.unique_keys():
        raise SchemaError(f"{spec.name}: {', '.join(key)} is not a unique key")


def one_per_key(rows: DataFrame, key: list[str]) -> DataFrame:
    """The largest row of each key, column by column; rows with a null in their key stay as they are."""
    others = [c for c in rows.columns if c not in key]
    whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in key))
    best = rows.where(whole).groupBy(*key).agg(F.max(F.struct(F.lit(0).alias("__"), *others)).alias("__s"))
    return best.select(*key, *[F.col(f"__s.{c}").alias(c) for c in others]).unionByName(rows.where(~whole))


def upsert(target: DataFrame, rows: DataFrame, key: list[str], keep: tuple[str, ...] = ("created_at",), touch: dict[str, Column] | None = None) -> DataFrame:
    """Insert rows or overwrite the columns given; columns absent from ``rows`` keep their values.

    Of several rows with one key one is taken (the largest, column by column, so the result is defined). ``keep`` columns
    stay as they were where a row existed. A key with a null never matches, neither a row of the target nor another new one: such rows are all inserted.
    """
    given = [c for c in rows.columns if c in target.columns]
    one = one_per_key(rows.select(*given), key)
    src = one.select(*[F.col(c).alias(f"s_{c}") for c in given], F.lit(True).alias("__new"))
    old = target.withColumn("__old", F.lit(True))
    both = old.join(src, reduce(lambda a, b: a & b, (F.col(c) == F.col(f"s_{c}") for c in key)), "full")
    cols = []
    for c in target.columns:
        if c in key:
            cols.append(F.coalesce(F.col(c), F.col(f"s_{c}")).alias(c))
        elif c in given:
            new = F.col(f"s_{c}").cast(target.schema[c].dataType)
            stays = F.col("__new").isNull() if c not in keep else F.col("__old").isNotNull()
            cols.append(F.when(stays, F.col(c)).otherwise(new).alias(c))
        elif touch and c in touch:
            cols.append(F.when(F.col("__new"), touch[c]).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return both.select(*cols)


def upsert_nothing(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Insert only rows whose key is new; of several rows with one key the largest. A key with a null is always new."""
    fresh = one_per_key(rows, key).join(target.select(*key), key, "left_anti")
    missing = [F.lit(None).cast(target.schema[c].dataType).alias(c) for c in target.columns if c not in rows.columns]
    return target.unionByName(fresh.select(*[c for c in target.columns if c in rows.columns], *missing))


def upsert_partial(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Change existing rows by primary key; an unknown key is a no-op."""
    return upsert(target, rows.join(target.select(key), key, "left_semi"), [key])


class VersionedTable:
    """A folder of versions ``v=N``; the largest committed version is current. Readers never see half a write."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.folder = Folder(spark, self.path)

    def versions(self) -> list[int]:
        return sorted(int(n[2:]) for n in self.folder.begun(self._names()))

    def _names(self) -> list[str]:
        return [n for n in self.folder.names() if n.startswith("v=")]

    def read(self, version: int | None = None) -> DataFrame:
        found = self.versions()
        if not found:
            raise SchemaError(f"no committed version at {self.path}")
        return self.spark.read.parquet(f"{self.path}/v={found[-1] if version is None else version}")

    def write(self, df: DataFrame, after: int | None = None) -> int:
        """Write the version that follows ``after`` (the one that ``df`` was made from; else the newest before writing).

        It is written beside the others and renamed into place. If another writer has taken that version, nothing is lost: the call
        raises WriteConflict and leaves no trace.
        """
        stage = self.folder.begin()
        version = ((self.versions() or [0])[-1] if after is None else after) + 1
        try:
            df.write.mode("append").parquet(f"{self.path}/{stage}")
            self.folder.finish(stage, f"v={version}")
        except BaseException:
            self.folder.delete(stage)
            raise
        return version

    def change(self, make: Callable[[DataFrame], DataFrame], attempts: int = 5) -> int:
        """Commit ``make(current rows)``; after a conflict it is made again from what the other writer left."""
        def once() -> int:
            now = (self.versions() or [0])[-1]
            return self.write(make(self.read(now)), now)

        return again(once, attempts)

    def provision(self, spec: TableSpec) -> None:
        """Create an empty first version unless there is one."""
        if not self.versions():
            try:
                self.write(self.spark.createDataFrame([], spec.struct), 0)
            except WriteConflict:
                pass  # another writer has just created it

    def vacuum(self, keep: int = 2, hours: float = 0.0, days: float = TAKEN_DAYS) -> None:
        """Empty all but the newest versions, as far as they are ``hours`` old, and remove stages that a day has not touched. A version's number stays taken
        for some days, until no writer that began before can ask for it."""
        names = self._names()
        with_rows = [f"v={v}" for v in self.versions()]
        for n in self.folder.older(with_rows[:-keep], hours):
            self.folder.clear(n)
        self.folder.sweep()
        for n in self.folder.older([n for n in names if n not in with_rows], 24 * days):
            self.folder.delete(n)


def newest_by(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row with the largest ``order`` for each key; of several, the largest row, column by column."""
    rest = [c for c in rows.columns if c != key]
    last = [f.name for f in rows.schema if f.name in rest and f.name not in order and not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order, *last)).alias("__s")).select(key, "__s.*")


class MergeTable:
    """Rows by key, of which the newest wins, for many small batches.

    A batch is appended as a part of its own, so its cost follows its own size. Once the parts outweigh the base they are folded
    into a new base, so all folds together write each row a number of times that grows with the logarithm of the table.
    """

    def __init__(self, spark: SparkSession, path: str, like: DataFrame, key: str, newest: list[str]):
        self.spark, self.path, self.schema, self.key, self.newest = spark, path.rstrip("/"), like.schema, key, newest
        self.log = Log(spark, self.path)

    def versions(self) -> list[str]:
        return self.log.live()

    def _rows(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{n}" for n in names])

    def _newest(self, names: list[str]) -> DataFrame:
        one = len(names) == 1 and names[0].endswith(BASE)
        return self._rows(names) if one else newest_by(self._rows(names), self.key, self.newest)

    def read(self) -> DataFrame:
        return self._newest(self.log.live())

    def append(self, rows: DataFrame) -> None:
        """Commit the newest row of each key in ``rows`` as a part; appending it again changes nothing.

        The order of parts does not matter, so a part that meets another writer's is written once and takes the next number.
        """
        with self.log.part(anywhere=True) as part:
            newest_by(rows.select(*self.schema.names), self.key, self.newest).write.mode("append").parquet(part.path)
        live = self.log.live()
        parts = [n for n in live if not n.endswith(BASE)]
        if len(parts) > 1 and self.log.bytes(parts) > self.log.bytes(live[: len(live) - len(parts)]):
            self.fold()

    def fold(self) -> None:
        """Write one base for all parts. Where another writer has just folded the same parts, that base counts."""
        if all(n.endswith(BASE) for n in self.log.live()):
            return
        try:
            with self.log.base() as base:
                self._newest(base.live).write.mode("append").parquet(base.path)
        except WriteConflict:
            pass
