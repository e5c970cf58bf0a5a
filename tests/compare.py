"""Run a query in Spark and its SQL in DuckDB, and compare rows without order."""

import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if isinstance(x, float):
        return "nan" if x != x else f"{x:.9g}"
    if isinstance(x, decimal.Decimal):
        return f"{float(x):.9g}"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(value, x)) + "]"
    if isinstance(x, dict):
        return "{" + ",".join(f"{k}:{value(v)}" for k, v in sorted(x.items())) + "}"
    if hasattr(x, "isoformat"):
        return x.isoformat().replace("T00:00:00", "")
    return str(x)


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    return con


def assert_same(spark, sf, run, sql):
    df = run(spark, sf)
    con = connect(sf)
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(want.fetchall(), want.columns)
