"""Views as join recipes over the foreign-key graph, joining only the tables whose columns are asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .schema import Catalog, SchemaError, ViewSpec

#: (table joined, its column, table joined before, that one's column)
Step = tuple[str, str, str, str]


def join_order(catalog: Catalog, tables: Iterable[str]) -> list[Step]:
    """Attach each table to those joined before it, through a foreign key in either direction.

    Tables attach in the order listed, as soon as an edge reaches them; where several do, the edge from the table joined last wins.
    """
    tables = list(tables)
    edges: list[Step] = []
    for t in tables:
        for f in catalog[t].fields:
            if f.references and (parent := f.references.split("."))[0] in tables:
                edges += [(parent[0], parent[1], t, f.name), (t, f.name, *parent)]
    joined, steps = tables[:1], []
    left = tables[1:]
    while left:
        for t in left:
            reach = [e for e in edges if e[0] == t and e[2] in joined]
            if reach:
                steps.append(max(reach, key=lambda e: joined.index(e[2])))
                joined.append(t)
                left.remove(t)
                break
        else:
            raise SchemaError(f"no foreign key connects {left} to {joined}")
    return steps


def needed_steps(catalog: Catalog, steps: list[Step], used: set[str]) -> list[Step]:
    """The steps on paths from the base to the used tables. A child joined to its parent multiplies rows, so it always stays."""
    keep: list[Step] = []
    want = set(used)
    for step in reversed(steps):
        table, column, _, _ = step
        fans_out = not catalog[table][column].primary  # the parent was joined first; this is the many side
        if table in want or fans_out:
            keep.append(step)
            want.add(step[2])
    return keep[::-1]


def view_frame(catalog: Catalog, view: ViewSpec, load: Callable[[str], DataFrame], columns: Iterable[str] | None = None) -> DataFrame:
    """The view's DataFrame with the given columns (default: all), all joins left outer.

    A left join to a parent by its primary key neither drops nor repeats rows, so tables without a used column are left out.
    """
    names = list(columns) if columns is not None else view.names
    picked = [(a, *view.source(a)) for a in names]
    base = view.tables[0]
    steps = needed_steps(catalog, join_order(catalog, view.tables), {t for _, t, _ in picked})
    used: dict[str, set[str]] = {}
    for _, t, f in picked:
        used.setdefault(t, set()).add(f)
    for t, c, s, d in steps:
        used.setdefault(t, set()).add(c)
        used.setdefault(s, set()).add(d)

    def part(t: str) -> DataFrame:
        return load(t).select(*[F.col(c).alias(f"{t}__{c}") for c in sorted(used.get(t, {catalog[t].key.name}))])

    out = part(base)
    for t, c, s, d in steps:
        out = out.join(part(t), F.col(f"{s}__{d}") == F.col(f"{t}__{c}"), "left")
    return out.select(*[F.col(f"{t}__{f}").alias(a) for a, t, f in picked])
