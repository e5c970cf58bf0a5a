"""The lazy, immutable query builder over catalog tables and views."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from . import hybrid, vector, writes
from .fulltext import TextIndex
from .pivots import PivotIndex
from .predicates import And, Filters, Predicate
from .substrings import SubstringIndex, need_of
from .schema import Catalog, SchemaError, TableSpec
from .views import view_frame

_RAW = re.compile(r"[(.`]")


class Database:
    """Named DataFrames under a catalog. ``vectors`` gives the (id, vector) rows of a table's searchable column or their pivot index, ``indexes`` the full-text index
    of a table's column or None, ``substrings`` its substring index or None; without an index searches read the text."""

    def __init__(
        self,
        catalog: Catalog,
        load: Callable[[str], DataFrame],
        vectors: Callable[[str, str], DataFrame | PivotIndex] | None = None,
        embedder: vector.Embedder | None = None,
        indexes: Callable[[str, str], TextIndex | None] | None = None,
        substrings: Callable[[str, str], SubstringIndex | None] | None = None,
    ):
        self.catalog, self.load, self.vectors, self.embedder, self.indexes, self.substrings = catalog, load, vectors, embedder, indexes, substrings

    def table(self, name: str) -> Query:
        if name not in self.catalog.tables and name not in self.catalog.views:
            raise SchemaError(f"unknown table or view {name}")
        return Query(self, name)

    def register_views(self) -> list[str]:
        """Create a temporary view for each of the catalog's views; returns their names."""
        for view in self.catalog.views.values():
            view_frame(self.catalog, view, self.load).createOrReplaceTempView(view.name)
        return list(self.catalog.views)

    def fetch_by_key(self, name: str, ids: Sequence[int]) -> DataFrame:
        """Point look-up by primary key."""
        return self.load(name).where(F.col(self.catalog[name].key.name).isin(list(ids)))


@dataclass(frozen=True)
class Query(Filters):
    """Each method returns a new query; :meth:`frame` is the DataFrame."""

    db: Database
    name: str
    items: tuple[str, ...] = ()
    keys: tuple[tuple[str, bool], ...] = ()
    most: int | None = None
    predicate: Predicate | None = None
    search: tuple = ()
    reranking: tuple = ()
    extra: dict = field(default_factory=dict)

    # -- building

    def where(self, p: Predicate) -> Query:
        return replace(self, predicate=p if self.predicate is None else And((self.predicate, p)))

    def select(self, *items: str) -> Query:
        """Names or raw expressions, also comma-separated in one string; nothing selects all."""
        flat = [x for i in items for x in re.split(r",(?![^()]*\))", i)]
        return replace(self, items=tuple(x.strip() for x in flat if x.strip()))

    def order(self, item: str, desc: bool = False) -> Query:
        return replace(self, keys=(*self.keys, (item, desc)))

    def limit(self, n: int) -> Query:
        return replace(self, most=int(n))

    def _fts_column(self, column: str | None) -> str:
        found = [a for a in self._names() if self._field(a).fts]
        if column is None:
            if len(found) != 1:
                raise SchemaError(f"{self.name} has {len(found)} searchable columns; name one")
            return found[0]
        if column not in found:
            raise SchemaError(f"{column} is not searchable")
        return column

    def keyword_search(self, query: str, column: str | None = None, topk: int | None = 50) -> Query:
        return replace(self, search=("keyword", tx.parse_keywords(query), self._fts_column(column)), keys=(), most=topk)

    def fts(self, query: str, column: str | None = None, topk: int | None = 50) -> Query:
        """The whole query as one phrase."""
        words = tx.analyze(query)
        return replace(self, search=("keyword", [tx.Term(words)] if words else [], self._fts_column(column)), keys=(), most=topk)

    def regex_search(self, pattern: str, column: str | None = None) -> Query:
        return self.regex(self._fts_column(column), pattern)

    def vector_search(self, query: str | Sequence[float], column: str, topk: int = 50) -> Query:
        """Predicates filter before scoring; any order is discarded; a later limit cuts further."""
        if not self._field(column).vector:
            raise SchemaError(f"{column} holds no vectors")
        return replace(self, search=("vector", self._embed(query), column, topk), keys=())

    def hybrid_search(self, query: str, vec_col: str = "embedding", kw_col: str = "content", topk: int = 50, alpha: float = 0.7, overquery: int = 3, vector_query: Sequence[float] | None = None) -> Query:
        return replace(self, search=("hybrid", self._embed(query if vector_query is None else vector_query), vec_col, tx.parse_keywords(query), self._fts_column(kw_col), topk, alpha, overquery), keys=())

    def rerank(self, query: str, content_column: str, topk: int = 10, reranker: hybrid.Reranker = hybrid.lexical_relevance) -> Query:
        return replace(self, reranking=(query, content_column, topk, reranker))

    # -- writing: the table's rows after the change, to be committed by a VersionedTable

    def _target(self) -> tuple[DataFrame, TableSpec]:
        if self._view:
            raise SchemaError(f"{self.name} is a view; write to its tables")
        return self.db.load(self.name), self.db.catalog[self.name]

    def _hit(self, df: DataFrame) -> Column:
        return F.lit(True) if self.predicate is None else self.predicate.column(lambda name: (F.col(name), self._type(df, name)))

    def insert(self, rows: DataFrame, order: list[str] | None = None) -> DataFrame:
        target, spec = self._target()
        return writes.insert(target, rows, spec, order)

    def update(self, changes: dict[str, Any]) -> DataFrame:
        """Set columns where the predicates hold."""
        target, spec = self._target()
        return writes.update_where(target, changes, self._hit(target), spec)

    def delete(self) -> DataFrame:
        """Without the rows that the predicates hold for."""
        target, _ = self._target()
        return writes.delete_where(target, self._hit(target))

    def upsert(self, rows: DataFrame, key: list[str]) -> DataFrame:
        target, spec = self._target()
        writes.check_conflict_key(spec, tuple(key))
        return writes.upsert(target, rows, key)

    # -- resolution

    @property
    def _view(self):
        return self.db.catalog.views.get(self.name)

    def _names(self) -> list[str]:
        return self._view.names if self._view else [f.name for f in self.db.catalog[self.name].fields]

    def _field(self, alias: str):
        if self._view:
            table, name = self._view.source(alias)
            return self.db.catalog[table][name]
        return self.db.catalog[self.name][alias]

    def _embed(self, query: str | Sequence[float]) -> Sequence[float]:
        if not isinstance(query, str):
            return query
        if self.db.embedder is None:
            raise SchemaError("a text query needs an embedder")
        return self.db.embedder([query])[0]

    def _source(self, columns: set[str]) -> DataFrame:
        for c in columns:
            self._field(c)
        if self._view:
            return view_frame(self.db.catalog, self._view, self.db.load, [n for n in self._names() if n in columns])
        return self.db.load(self.name).select(*[n for n in self._names() if n in columns])

    def _used(self) -> set[str]:
        """Columns that this query reads; a raw expression may read any."""
        names = set(self._names())
        raw = [x for x in (*self.items, *(k for k, _ in self.keys)) if _RAW.search(x)]
        used = names.copy() if not self.items else {x for x in self.items if not _RAW.search(x)}
        for x in raw:
            used |= {n for n in names if re.search(rf"\b{re.escape(n)}\b", x)}
        used |= {k for k, _ in self.keys if not _RAW.search(k) and not k.startswith("_")}
        used |= self.predicate.fields() if self.predicate else set()
        if self.reranking:
            used.add(self.reranking[1])
        if self.search or self.reranking:
            used.add("id")
        return used

    def _filtered(self, columns: set[str]) -> DataFrame:
        df = self._source(columns)
        if self.predicate is None:
            return df
        return self._narrowed(df, columns).where(self.predicate.column(lambda name: (F.col(name), self._type(df, name))))

    def _narrowed(self, df: DataFrame, columns: set[str]) -> DataFrame:
        """The rows that a substring index names for the pattern predicates, where there is one; all rows otherwise."""
        if self.db.substrings is None or self._view and len(self._view.tables) > 1:
            return df
        for column, need in need_of(self.predicate):
            table, name = self._view.source(column) if self._view else (self.name, column)
            key = "id" if self._view else self.db.catalog[self.name].key.name
            index = self.db.substrings(table, name)
            if index is not None:
                df = index.narrow(df if key in df.columns else self._source({*columns, key}), key, need)
        return df.select(*[n for n in df.columns if n in columns])

    @staticmethod
    def _type(df: DataFrame, name: str) -> T.DataType:
        return df.schema[name].dataType

    def _nearest(self, column: str, query: Sequence[float], k: int, ids: DataFrame, score: str = "score") -> DataFrame:
        """(id, score) of the k nearest rows of ``ids``; from the groups that can hold them, where the vectors are indexed."""
        table, name = self._view.source(column) if self._view else (self.name, column)
        if self.db.vectors is None:
            raise SchemaError(f"no vectors of {table}.{name}")
        found = self.db.vectors(table, name)
        if isinstance(found, PivotIndex):
            return found.search(query, k, ids).withColumnRenamed("score", score)
        # scores move to the ids, not vectors
        scored = vector.scores(found, "id", "vector", query, score).select("id", score)
        return scored.join(ids, "id", "left_semi").orderBy(F.desc(score), F.asc("id")).limit(k)

    def _keyword_ranks(self, terms: list[tx.Term], column: str, most: int | None = None) -> DataFrame:
        """Ranks over the whole column, before any predicate; from its index where there is one. Without a predicate the ``most`` best will do."""
        table, name = self._view.source(column) if self._view else (self.name, column)
        # a view with more tables than the column's repeats or lacks its rows
        alone = not self._view or len(self._view.tables) == 1
        index = self.db.indexes(table, name) if self.db.indexes and alone else None
        if index is not None:
            return index.bm25(terms) if most is None or self.predicate is not None else index.best(terms, most)
        return tx.bm25(self._source({"id", column}), "id", column, terms)

    # -- running

    def frame(self) -> DataFrame:
        """The result; searches add ``_score``, best first."""
        df = self._filtered(self._used())
        if self.search:
            kind, *rest = self.search
            if kind == "keyword":
                terms, column = rest
                ranks = self._keyword_ranks(terms, column, None if self.keys else self.most)
                df = df.join(ranks, "id").withColumn("_score", -F.col("rank")).drop("rank")
            elif kind == "vector":
                query, column, topk = rest
                best = self._nearest(column, query, topk, df.select("id"), "_score")
                df = df.join(F.broadcast(best), "id")  # at most topk rows
            else:
                query, vec_col, terms, kw_col, topk, alpha, over = rest
                ids = df.select("id")
                v = self._nearest(vec_col, query, topk * over, ids)
                k = self._keyword_ranks(terms, kw_col, topk * over).join(ids, "id", "left_semi").orderBy("rank", "id").limit(topk * over)
                best = hybrid.fuse(v, k, "id", topk, alpha).select("id", F.col("score").alias("_score"))
                df = df.join(F.broadcast(best), "id")  # at most topk rows
        keys = [self._order(k, d) for k, d in self.keys] or ([F.desc("_score"), F.asc("id")] if self.search else [])
        if keys:
            df = df.orderBy(*keys)
        if self.most is not None:
            df = df.limit(self.most)
        if self.reranking:
            query, content, topk, reranker = self.reranking
            df = hybrid.rerank(df, query, content, topk, "_score", reranker)
        if not self.items:
            return df
        picked = [F.expr(x) if _RAW.search(x) else F.col(x) for x in self.items]
        extra = [F.col(c) for c in ("_score", "original__score") if c in df.columns]
        return df.select(*picked, *extra)

    @staticmethod
    def _order(item: str, desc: bool) -> Column:
        c = F.expr(item) if _RAW.search(item) or item.upper().startswith("CASE ") else F.col(item)
        return c.desc_nulls_last() if desc else c.asc_nulls_first()

    def count(self) -> DataFrame:
        """One row ``count``: rows that the predicates leave; order, limit and search do not matter."""
        used = self.predicate.fields() if self.predicate else set()
        return self._filtered(used or {"id"}).agg(F.count("*").alias("count"))
