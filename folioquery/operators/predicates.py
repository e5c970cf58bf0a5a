"""Predicates as data, and their Spark columns. All follow SQL's three-valued logic."""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fold_ascii(c: Column) -> Column:
    """A-Z lower-cased; other letters keep their case."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def like_pattern(pattern: str) -> str:
    """Without % or _ a pattern matches anywhere. A backslash is an ordinary character."""
    if "%" not in pattern and "_" not in pattern:
        pattern = f"%{pattern}%"
    return pattern.replace("\\", "\\\\")


def java_regex(pattern: str) -> str | None:
    """The pattern for Spark, or None if Python does not accept it (such a pattern matches no row)."""
    try:
        re.compile(pattern, re.IGNORECASE)
    except re.error:
        return None
    pattern = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)
    pattern = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern)
    return "(?iu)" + pattern.replace(r"\Z", r"\z")


Resolve = Callable[[str], tuple[Column, T.DataType]]


class Predicate:
    def column(self, at: Resolve) -> Column:
        raise NotImplementedError

    def fields(self) -> set[str]:
        raise NotImplementedError

    def __and__(self, other: Predicate) -> Predicate:
        return And((self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Or((self, other))


@dataclass(frozen=True)
class Leaf(Predicate):
    """One comparison; ``op`` names it."""

    op: str
    field: str
    value: Any = None

    def fields(self) -> set[str]:
        return {self.field}

    def column(self, at: Resolve) -> Column:
        c, kind = at(self.field)
        return getattr(self, f"_{self.op}")(c, kind, self.value)

    @staticmethod
    def _eq(c: Column, kind: T.DataType, v: Any) -> Column:
        return c.isNull() if v is None else c == F.lit(v)

    @staticmethod
    def _neq(c: Column, kind: T.DataType, v: Any) -> Column:
        return c.isNotNull() if v is None else c != F.lit(v)

    @staticmethod
    def _gt(c: Column, kind: T.DataType, v: Any) -> Column:
        return c > F.lit(v)

    @staticmethod
    def _gte(c: Column, kind: T.DataType, v: Any) -> Column:
        return c >= F.lit(v)

    @staticmethod
    def _lt(c: Column, kind: T.DataType, v: Any) -> Column:
        return c < F.lit(v)

    @staticmethod
    def _lte(c: Column, kind: T.DataType, v: Any) -> Column:
        return c <= F.lit(v)

    @staticmethod
    def _in(c: Column, kind: T.DataType, v: Sequence) -> Column:
        return c.isin(list(v)) if v else F.lit(False)

    @staticmethod
    def _not_in(c: Column, kind: T.DataType, v: Sequence) -> Column:
        return ~c.isin(list(v)) if v else F.lit(True)

    @staticmethod
    def _contains(c: Column, kind: T.DataType, v: Any) -> Column:
        """Any of the values is an element of an array, a key of a map or JSON object; typed equality; scalars hold nothing."""
        values = list(v) if isinstance(v, (list, tuple, set)) else [v]
        if not values:
            return F.lit(False)
        if isinstance(kind, T.ArrayType):
            one_kind = {T.StringType: str, T.LongType: int, T.IntegerType: int, T.DoubleType: float, T.BooleanType: bool}.get(type(kind.elementType), object)
            values = [x for x in values if type(x) is one_kind or one_kind is object]
            return F.coalesce(F.arrays_overlap(c, F.array(*map(F.lit, values)).cast(kind)), F.lit(False)) if values else F.lit(False)
        if isinstance(kind, T.MapType):
            return F.coalesce(reduce(lambda a, b: a | b, (F.map_contains_key(c, F.lit(x)) for x in values)), F.lit(False))
        if isinstance(kind, T.StringType):
            return json_contains(c, values)
        raise TypeError("contains needs an array, a map or JSON text")

    @staticmethod
    def _ilike(c: Column, kind: T.DataType, v: str) -> Column:
        return fold_ascii(c.cast("string")).like(fold_pattern(like_pattern(v)))

    @staticmethod
    def _ilike_prefix(c: Column, kind: T.DataType, v: str) -> Column:
        return fold_ascii(c.cast("string")).like(fold_pattern(v.replace("\\", "\\\\") + "%"))

    @staticmethod
    def _regex(c: Column, kind: T.DataType, v: str) -> Column:
        pattern = java_regex(v)
        return F.lit(False) if pattern is None else F.coalesce(c.cast("string"), F.lit("")).rlike(pattern)


def fold_pattern(p: str) -> str:
    return p.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def json_contains(c: Column, values: Sequence) -> Column:
    """Containment in JSON text: object keys, or array elements equal in type and value."""
    keys = F.json_object_keys(c)
    texts = [x for x in values if isinstance(x, str)]
    in_object = F.arrays_overlap(keys, F.array(*map(F.lit, texts))) if texts else F.lit(False)
    items = F.from_json(c, "array<string>")
    quoted = F.transform(F.from_json(c, "array<variant>"), lambda x: F.concat(F.schema_of_variant(x), F.lit(":"), x.cast("string")))
    wanted = []
    for x in values:
        name = {str: ("STRING",), bool: ("BOOLEAN",), int: ("BIGINT",), float: ("DOUBLE",)}[type(x)]
        wanted += [f"{n}:{str(x).lower() if isinstance(x, bool) else x}" for n in name]
    in_array = F.arrays_overlap(quoted, F.array(*map(F.lit, wanted))) & items.isNotNull()
    first = F.substring(F.ltrim(c), 1, 1)
    return F.coalesce(F.when(first == "{", in_object).when(first == "[", in_array), F.lit(False))


@dataclass(frozen=True)
class And(Predicate):
    parts: tuple[Predicate, ...]

    def fields(self) -> set[str]:
        return set().union(*(p.fields() for p in self.parts))

    def column(self, at: Resolve) -> Column:
        return reduce(lambda a, b: a & b, (p.column(at) for p in self.parts), F.lit(True))


@dataclass(frozen=True)
class Or(Predicate):
    parts: tuple[Predicate, ...]

    def fields(self) -> set[str]:
        return set().union(*(p.fields() for p in self.parts))

    def column(self, at: Resolve) -> Column:
        return reduce(lambda a, b: a | b, (p.column(at) for p in self.parts), F.lit(False))


class Filters:
    """Chainable predicates for anything with ``where(Predicate)``. A bound of None is no bound."""

    def where(self, p: Predicate):
        raise NotImplementedError

    def eq(self, f: str, v: Any):
        return self.where(Leaf("eq", f, v))

    def neq(self, f: str, v: Any):
        return self.where(Leaf("neq", f, v))

    def gt(self, f: str, v: Any):
        return self if v is None else self.where(Leaf("gt", f, v))

    def gte(self, f: str, v: Any):
        return self if v is None else self.where(Leaf("gte", f, v))

    def lt(self, f: str, v: Any):
        return self if v is None else self.where(Leaf("lt", f, v))

    def lte(self, f: str, v: Any):
        return self if v is None else self.where(Leaf("lte", f, v))

    def in_(self, f: str, v: Sequence):
        return self.where(Leaf("in", f, tuple(v)))

    def not_in(self, f: str, v: Sequence):
        return self.where(Leaf("not_in", f, tuple(v)))

    def is_null(self, f: str):
        return self.eq(f, None)

    def is_not_null(self, f: str):
        return self.neq(f, None)

    def between(self, f: str, lo: Any, hi: Any):
        return self.gte(f, lo).lte(f, hi)

    def contains(self, f: str, v: Any):
        return self.where(Leaf("contains", f, tuple(v) if isinstance(v, (list, set)) else v))

    def ilike(self, f: str, v: str):
        return self.where(Leaf("ilike", f, v))

    def ilike_prefix(self, f: str, v: str):
        return self.where(Leaf("ilike_prefix", f, v))

    def regex(self, f: str, v: str):
        return self.where(Leaf("regex", f, v))
