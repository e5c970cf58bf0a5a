"""Declarative catalog: typed tables, constraints, foreign-key views and their validation.

A table is a :class:`TableSpec`; its rows live in a DataFrame of :meth:`TableSpec.struct`. Spark enforces no
constraint, so :func:`violations` and :func:`check_constraints` state them as queries.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SchemaError(ValueError):
    """A declaration that cannot stand."""


class ConstraintError(ValueError):
    """Rows that break a declared constraint."""


class NotNullError(ConstraintError):
    pass


class UniqueError(ConstraintError):
    pass


class CheckError(ConstraintError):
    pass


class ForeignKeyError(ConstraintError):
    pass


#: Declared type to Spark type; json columns name their own Spark type.
KINDS = {"serial": "bigint", "text": "string", "integer": "bigint", "float": "double", "boolean": "boolean", "date": "date", "timestamp": "timestamp", "enum": "string", "json": "string"}
# Names that a column may not have.
RESERVED = frozenset("abort action add all alter and as asc between by case cast check collate column commit constraint create cross default delete desc distinct drop else end escape except exists foreign from full group having in inner insert intersect into is isnull join left like limit natural not notnull null offset on or order outer primary references right rollback rowid select set table then to transaction trigger union unique update using values view virtual when where with without".split())


@dataclass(frozen=True)
class FieldSpec:
    name: str
    kind: str
    spark: str = ""
    nullable: bool = True
    unique: bool = False
    primary: bool = False
    index: bool = False
    default: str | None = None
    auto_update: bool = False
    choices: tuple[str, ...] = ()
    references: str | None = None
    on_delete: str = "CASCADE"
    fts: bool = False
    vector: bool = False
    contextualized: bool = False

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise SchemaError(f"unknown type {self.kind}")
        if not re.fullmatch(r"[A-Za-z_]\w{0,63}", self.name) or self.name.lower() in RESERVED:
            raise SchemaError(f"bad column name {self.name!r}")
        if self.kind == "enum" and (not self.choices or not all(self.choices) or (self.default is not None and self.default not in self.choices)):
            raise SchemaError(f"{self.name}: an enum needs non-empty choices that include its default")
        if self.contextualized and not self.vector:
            raise SchemaError(f"{self.name}: contextualized needs vector")
        if self.kind == "serial" and self.references:
            raise SchemaError(f"{self.name}: a serial key cannot reference another table")
        if (self.fts or self.vector) and self.kind != "text":
            raise SchemaError(f"{self.name}: only text can be searched")

    @property
    def sql_type(self) -> str:
        return self.spark or KINDS[self.kind]


@dataclass(frozen=True)
class TableSpec:
    name: str
    fields: tuple[FieldSpec, ...]
    uniques: tuple[tuple[str, ...], ...] = ()

    def __post_init__(self) -> None:
        names = [f.name for f in self.fields]
        if len(set(names)) != len(names):
            raise SchemaError(f"{self.name}: duplicate field")
        for key in self.uniques:
            if missing := set(key) - set(names):
                raise SchemaError(f"{self.name}: unique names unknown fields {sorted(missing)}")

    def __getitem__(self, name: str) -> FieldSpec:
        for f in self.fields:
            if f.name == name:
                return f
        raise SchemaError(f"{self.name} has no field {name}")

    def __contains__(self, name: str) -> bool:
        return any(f.name == name for f in self.fields)

    @property
    def key(self) -> FieldSpec:
        return next((f for f in self.fields if f.primary), self.fields[0])

    @property
    def struct(self) -> T.StructType:
        out = T.StructType()
        for f in self.fields:
            marks = {k: v for k, v in asdict(f).items() if k in ("fts", "vector", "contextualized", "choices", "references") and v}
            out.add(T.StructField(f.name, T._parse_datatype_string(f.sql_type) if f.spark else T._parse_datatype_string(KINDS[f.kind]), f.nullable and not f.primary, marks or None))
        return out

    def marked(self, flag: str) -> list[str]:
        """Columns with a flag: fts, vector, index or contextualized."""
        return [f.name for f in self.fields if getattr(f, flag)]

    def add_field(self, f: FieldSpec) -> TableSpec:
        return replace(self, fields=(*self.fields, f))

    def remove_field(self, name: str) -> TableSpec:
        self[name]
        return replace(self, fields=tuple(f for f in self.fields if f.name != name), uniques=tuple(u for u in self.uniques if name not in u))

    def unique_keys(self) -> list[tuple[str, ...]]:
        return [(f.name,) for f in self.fields if f.primary or f.unique] + list(self.uniques)


@dataclass(frozen=True)
class ViewSpec:
    """alias -> (table, field) over foreign-key-connected tables; the first table is the base."""

    name: str
    tables: tuple[str, ...]
    columns: tuple[tuple[str, str, str], ...]

    def source(self, alias: str) -> tuple[str, str]:
        for a, t, f in self.columns:
            if a == alias:
                return t, f
        raise SchemaError(f"{self.name} has no field {alias}")

    @property
    def names(self) -> list[str]:
        return [c[0] for c in self.columns]


@dataclass(frozen=True)
class Catalog:
    tables: dict[str, TableSpec] = field(default_factory=dict)
    views: dict[str, ViewSpec] = field(default_factory=dict)
    reserved: frozenset[str] = frozenset()

    def add_table(self, t: TableSpec) -> Catalog:
        if t.name in self.tables or t.name in self.views or t.name in self.reserved or t.name.startswith("_sys_"):
            raise SchemaError(f"the name {t.name} is taken or reserved")
        return replace(self, tables={**self.tables, t.name: t})

    def update_table(self, t: TableSpec) -> Catalog:
        self[t.name]
        return replace(self, tables={**self.tables, t.name: t})

    def reserve_names(self, names: Iterable[str]) -> Catalog:
        return replace(self, reserved=self.reserved | set(names))

    def add_view(self, v: ViewSpec) -> Catalog:
        from .views import join_order

        if v.name in self.views or v.name in self.tables:
            raise SchemaError(f"the name {v.name} is taken")
        for _, t, f in v.columns:
            if t not in v.tables:
                raise SchemaError(f"{v.name} reads {t}, which it does not list")
            self[t][f]
        if "id" in v.names and not self[v.source("id")[0]][v.source("id")[1]].primary:
            raise SchemaError(f"{v.name}: id must be a primary key")
        join_order(self, v.tables)
        return replace(self, views={**self.views, v.name: v})

    def __getitem__(self, name: str) -> TableSpec:
        if name not in self.tables:
            raise SchemaError(f"unknown table {name}")
        return self.tables[name]

    def validate(self) -> None:
        """Foreign keys must meet a primary key of equal type."""
        for t in self.tables.values():
            for f in t.fields:
                if f.references:
                    other, name = f.references.split(".")
                    target = self[other][name]
                    if not target.primary or target.sql_type != f.sql_type:
                        raise SchemaError(f"{t.name}.{f.name} does not match a primary key at {f.references}")

    def to_dict(self) -> dict:
        """Tables and views as plain data; :meth:`from_dict` restores both."""
        return {"tables": [asdict(t) for t in self.tables.values()], "views": [asdict(v) for v in self.views.values()]}

    @classmethod
    def from_dict(cls, data: dict) -> Catalog:
        out = cls()
        for t in data["tables"]:
            fields = tuple(FieldSpec(**{**f, "choices": tuple(f["choices"])}) for f in t["fields"])
            out = out.add_table(TableSpec(t["name"], fields, tuple(map(tuple, t["uniques"]))))
        for v in data["views"]:
            out = out.add_view(ViewSpec(v["name"], tuple(v["tables"]), tuple(map(tuple, v["columns"]))))
        return out

    def hash(self) -> str:
        return hashlib.sha256(json.dumps(self.to_dict(), sort_keys=True).encode()).hexdigest()


def define(name: str, text: str, *uniques: tuple[str, ...]) -> TableSpec:
    """A table from lines ``column kind [flag ...]``.

    Flags: ``!`` not null, ``unique``, ``index``, ``fts``, ``vector``, ``as:<spark type>``, ``default:<value>``, ``touch``
    (set on update), ``of:a|b`` choices, ``fk:table.column``. A line that starts with ``|`` continues the choices above.
    """
    lines: list[str] = []
    for line in filter(None, map(str.strip, text.splitlines())):
        if line.startswith("|"):
            lines[-1] += line
        else:
            lines.append(line)
    fields = []
    for line in lines:
        column, kind, *flags = line.split(" ", 2)
        said: dict = {"primary": kind == "serial"}
        for flag in flags[0].split(" ") if flags else []:
            head, _, rest = flag.partition(":")
            said |= {
                "!": {"nullable": False},
                "as": {"spark": rest},
                "default": {"default": rest.replace("_", " ") if kind == "enum" and "_" not in rest else rest},
                "touch": {"auto_update": True},
                "of": {"choices": tuple(x.replace("~", " ") for x in rest.split("|"))},
                "fk": {"references": rest},
            }.get(head) or {head: True}
        fields.append(FieldSpec(column, kind, **said))
    return TableSpec(name, tuple(fields), tuple(uniques))


# ---------------------------------------------------------------- values


def coerce(column: Column, kind: str) -> Column:
    """Input text to the declared type; null where it cannot be read.

    integers: digit strings only; booleans: true/t/yes/y/1 and false/f/no/n/0; dates: strict YYYY-MM-DD; timestamps: ISO-8601,
    without a zone taken as UTC.
    """
    s = F.trim(column.cast("string"))
    low = F.lower(s)
    if kind in ("integer", "serial"):
        return F.when(s.rlike(r"^\d+$"), s.try_cast("bigint"))
    if kind == "float":
        return s.try_cast("double")
    if kind == "boolean":
        return F.when(low.isin("true", "t", "yes", "y", "1"), True).when(low.isin("false", "f", "no", "n", "0"), False)
    if kind == "date":
        return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), s.try_cast("date"))
    if kind == "timestamp":
        return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), s.try_cast("timestamp"))
    return column.cast("string")


def decode_json(df: DataFrame, spec: TableSpec) -> DataFrame:
    """JSON columns that hold text, as the type that the schema states for them (``as:``); text of another shape is null."""
    kinds = {f.name: f.spark for f in spec.fields if f.kind == "json" and f.spark}
    texts = {c for c, t in df.dtypes if t == "string"}
    return df.select(*[F.from_json(c, kinds[c]).alias(c) if c in kinds and c in texts else F.col(c) for c in df.columns])


def encode_json(df: DataFrame, spec: TableSpec) -> DataFrame:
    """JSON columns as text, for stores that have no nested types; the inverse of ``decode_json``."""
    kinds = {f.name for f in spec.fields if f.kind == "json"}
    return df.select(*[F.to_json(c).alias(c) if c in kinds and t != "string" else F.col(c) for c, t in df.dtypes])


def violations(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Rows with ``_reason``: which not-null or choice rule each breaks (good rows do not come out)."""
    reasons = []
    for f in spec.fields:
        if f.name not in df.columns:
            if not f.nullable and f.default is None and not f.primary:
                reasons.append(F.lit(f"not null: {f.name}"))
            continue
        if not f.nullable or f.primary:
            reasons.append(F.when(F.col(f.name).isNull(), F.lit(f"not null: {f.name}")))
        if f.choices:
            reasons.append(F.when(F.col(f.name).isNotNull() & ~F.col(f.name).isin(*f.choices), F.lit(f"check: {f.name}")))
    reason = F.coalesce(*reasons) if reasons else F.lit(None).cast("string")
    return df.withColumn("_reason", reason).where("_reason IS NOT NULL")


def split_valid(df: DataFrame, spec: TableSpec) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with ``_reason``); unknown columns are refused."""
    if unknown := set(df.columns) - {f.name for f in spec.fields}:
        raise SchemaError(f"{spec.name} has no fields {sorted(unknown)}")
    bad = violations(df, spec)
    keys = [f for f in spec.fields if f.name in df.columns]
    ok = F.lit(True)
    for f in keys:
        if not f.nullable or f.primary:
            ok = ok & F.col(f.name).isNotNull()
        if f.choices:
            ok = ok & (F.col(f.name).isNull() | F.col(f.name).isin(*f.choices))
    absent = [f for f in spec.fields if f.name not in df.columns and not f.nullable and f.default is None and not f.primary]
    return df.where(F.lit(not absent) & ok), bad


def check_constraints(df: DataFrame, spec: TableSpec, parents: dict[str, DataFrame] | None = None) -> None:
    """Raise the matching error if rows break a constraint: not null, choices, uniqueness, foreign keys."""
    bad = violations(df, spec).select("_reason").limit(1).collect()
    if bad:
        raise (NotNullError if bad[0][0].startswith("not null") else CheckError)(f"{spec.name}: {bad[0][0]}")
    for key in spec.unique_keys():
        if set(key) <= set(df.columns):
            known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in key))
            if df.where(known).groupBy(*key).count().where("count > 1").limit(1).count():
                raise UniqueError(f"{spec.name}: {', '.join(key)}")
    for f in spec.fields:
        if f.references and f.name in df.columns and parents and f.references.split(".")[0] in parents:
            table, column = f.references.split(".")
            lost = df.where(F.col(f.name).isNotNull()).join(parents[table].select(F.col(column).alias("__fk")), F.col(f.name) == F.col("__fk"), "left_anti")
            if lost.limit(1).count():
                raise ForeignKeyError(f"{spec.name}.{f.name}")
