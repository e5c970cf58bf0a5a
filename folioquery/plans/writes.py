"""Writes: inserts, updates, deletes, upserts, and validation, shown on customers and orders."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import schema as sc
from ..operators import writes as wr
from ..operators.keyed import KeyedTable
from ..operators.store import Store
from ..storage import shared_dir
from .fixtures import loader, star_catalog
from .registry import query


def _changes(spark, d):
    """Suppliers as incoming customers: keys 1..n meet existing ones, others are new."""
    s = loader(spark, d)("supplier")
    return s.select((F.col("s_suppkey") * 40).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))


_SRC = "SELECT s_suppkey * 40 AS c_custkey, s_name AS c_name, s_acctbal AS c_acctbal FROM supplier"


@query(f"SELECT coalesce(c.c_custkey, s.c_custkey) AS c_custkey, coalesce(s.c_name, c.c_name) AS c_name, coalesce(s.c_acctbal, c.c_acctbal) AS c_acctbal, c_nationkey FROM customer c FULL JOIN ({_SRC}) s ON c.c_custkey = s.c_custkey")
def upsert_update(spark, d):
    out = wr.upsert(loader(spark, d)("customer"), _changes(spark, d), ["c_custkey"])
    return out.select("c_custkey", "c_name", "c_acctbal", "c_nationkey")


@query(f"SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT * FROM ({_SRC}) WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)")
def upsert_nothing(spark, d):
    return wr.upsert_nothing(loader(spark, d)("customer"), _changes(spark, d), ["c_custkey"]).select("c_custkey", "c_name", "c_acctbal")


@query(f"SELECT c.c_custkey, coalesce(s.c_name, c.c_name) AS c_name, c_mktsegment FROM customer c LEFT JOIN ({_SRC}) s USING (c_custkey)")
def upsert_partial(spark, d):
    return wr.upsert_partial(loader(spark, d)("customer"), _changes(spark, d).select("c_custkey", "c_name"), "c_custkey").select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def update_where(spark, d):
    out = wr.update_where(loader(spark, d)("orders"), {"o_orderstatus": "X"}, F.col("o_totalprice") > 100000, star_catalog()["orders"])
    return out.select("o_orderkey", "o_orderstatus")


@query("SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE quality IS NULL OR quality <> 0")
def delete_where(spark, d):
    """Rows where the predicate is unknown stay."""
    load = loader(spark, d)
    rows = load("documents").join(load("labels"), "doc_id", "left").select("doc_id", "quality")
    return wr.delete_where(rows, F.col("quality") == 0)


@query(f"""
WITH u AS (SELECT coalesce(c.c_custkey, s.c_custkey) AS c_custkey, coalesce(s.c_name, c.c_name) AS c_name, coalesce(s.c_acctbal, c.c_acctbal) AS c_acctbal, c_nationkey FROM customer c FULL JOIN ({_SRC}) s ON c.c_custkey = s.c_custkey)
SELECT c_custkey, c_name, c_acctbal, c_nationkey FROM u WHERE c_custkey % 7 <> 0 OR c_custkey NOT IN (SELECT c_custkey FROM customer)
""")
def upsert_touched(spark, d):
    """The same upsert, then a delete, on a table that rewrites only the files with those keys."""
    customers = loader(spark, d)("customer")
    table = KeyedTable(spark, f"{shared_dir(spark)}/keyed-{uuid.uuid4().hex}", "c_custkey", per_file=500)
    table.create(customers)
    table.upsert(_changes(spark, d))
    table.delete(customers.where("c_custkey % 7 = 0").select("c_custkey"))
    return table.read().select("c_custkey", "c_name", "c_acctbal", "c_nationkey")


@query("SELECT s_suppkey, s_name, CASE WHEN s_acctbal < 0 THEN 'debt' END AS note FROM supplier WHERE s_suppkey % 3 <> 0")
def store_commits(spark, d):
    """A store is provisioned, filled, changed and opened again by its catalog."""
    root = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    catalog = sc.Catalog().add_table(sc.define("s", "id serial\ns_suppkey integer !\ns_name text\ns_acctbal float\nnote text"))
    rows = loader(spark, d)("supplier").select("s_suppkey", "s_name", "s_acctbal")
    store = Store(spark, root if "://" in root else f"file://{root}", catalog)
    store.commit("s", lambda q: q.insert(rows, ["s_suppkey"]))
    store.commit("s", lambda q: q.lt("s_acctbal", 0.0).update({"note": "debt"}))
    store.commit("s", lambda q: wr.delete_where(q.frame(), F.col("s_suppkey") % 3 == 0))
    return Store(spark, store.root, catalog).load("s").select("s_suppkey", "s_name", "note")


_KEPT = "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE NOT (c_mktsegment = 'BUILDING'))"


@query(f"SELECT 'orders' AS tbl, o_orderkey AS k, CAST(0 AS BIGINT) AS n FROM ({_KEPT}) UNION ALL SELECT 'lineitem', l_orderkey, count(*) FROM lineitem WHERE l_orderkey IN ({_KEPT}) GROUP BY 2")
def delete_cascade(spark, d):
    load = loader(spark, d)
    tables = {t: load(t) for t in ("customer", "orders", "lineitem")}
    out = wr.delete_cascade(star_catalog(), tables, "customer", F.col("c_mktsegment") == "BUILDING")
    orders = out["orders"].select(F.lit("orders").alias("tbl"), F.col("o_orderkey").alias("k"), F.lit(0).cast("long").alias("n"))
    lines = out["lineitem"].groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    return orders.unionByName(lines.select(F.lit("lineitem").alias("tbl"), "k", "n"))


@query("SELECT count(*) AS n, count(DISTINCT c_custkey) AS ids, min(c_custkey) AS low, max(c_custkey) AS high FROM (SELECT c_custkey FROM customer UNION ALL SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY s_suppkey) FROM supplier)")
def insert_allocate(spark, d):
    """New keys follow the largest one without gaps."""
    load = loader(spark, d)
    rows = load("supplier").select(F.col("s_name").alias("c_name"), F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"), F.lit("NEW").alias("c_mktsegment"))
    out = wr.insert(load("customer"), rows, star_catalog()["customer"], ["c_name", "c_acctbal"])
    return out.agg(F.count("*").alias("n"), F.count_distinct("c_custkey").alias("ids"), F.min("c_custkey").alias("low"), F.max("c_custkey").alias("high"))


@query("SELECT o_orderkey, 'check: o_orderpriority' AS _reason FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '5-LOW')")
def validate_rows(spark, d):
    """Rows that break a declared rule, with the reason."""
    spec = sc.define("orders", "o_orderkey serial\no_orderpriority enum ! of:1-URGENT|2-HIGH|5-LOW")
    return sc.violations(loader(spark, d)("orders").select("o_orderkey", "o_orderpriority"), spec).select("o_orderkey", "_reason")


@query("""
SELECT c_custkey, '["' || string_agg(DISTINCT o_orderstatus, '","' ORDER BY o_orderstatus) || '"]' AS tags, count(DISTINCT o_orderstatus)::BIGINT AS n, min(year(o_orderdate)) AS first_year
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_custkey
""")
def json_columns(spark, d):
    """Arrays as JSON text and back: what is stored, and what is read from it."""
    rows = loader(spark, d)("customer_tags")
    spec = star_catalog()["customer_tags"]
    text = sc.encode_json(rows, spec)
    back = sc.decode_json(text, spec).select("c_custkey", F.size("tags").cast("long").alias("n"), F.array_min("years").alias("first_year"))
    return text.select("c_custkey", "tags").join(back, "c_custkey")


@query("""
SELECT event_id, CASE WHEN regexp_full_match(s, '\\d+') THEN CAST(s AS BIGINT) END AS as_int,
       CASE WHEN lower(s) IN ('1', 't', 'true', 'y', 'yes') THEN true WHEN lower(s) IN ('0', 'f', 'false', 'n', 'no') THEN false END AS as_bool
FROM (SELECT event_id, ['12', '-1', 'yes', 'F', '0', '1', 'x'][event_id % 7 + 1] AS s FROM events)
""")
def coerce_values(spark, d):
    s = F.get(F.array(*map(F.lit, ("12", "-1", "yes", "F", "0", "1", "x"))), (F.col("event_id") % 7).cast("int"))
    return loader(spark, d)("events").select("event_id", sc.coerce(s, "integer").alias("as_int"), sc.coerce(s, "boolean").alias("as_bool"))


@query("SELECT user_id, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def stream_incremental_upsert(spark, d):
    """Events stream in by file; each micro-batch upserts the newest state of its users."""
    from ..streaming.ingest import incremental_upsert

    events = loader(spark, d)("events").select("event_id", "ts", "user_id", "value")
    return incremental_upsert(spark, events, f"{d}/events.parquet", key="user_id", newest=["ts", "event_id"]).select("user_id", "ts", "value")


@query("""
SELECT page_id AS filing_id, CASE WHEN page_id % 11 = 5 THEN NULL ELSE 1 END AS num_pages, page_id % 11 <> 5 AS synced,
       CASE WHEN page_id % 11 = 5 THEN 'source' END AS failed, CASE WHEN page_id % 11 = 5 THEN 0 ELSE 1 END::BIGINT AS pages
FROM pages
""")
def ingest_filings(spark, d):
    """Pages written as filings on disk, then taken in by two runs of a stream: the second reads what is new alone. Files that are missing are errors."""
    from ..sources import filings as source
    from ..streaming.ingest import FilingIngest

    at = f"{shared_dir(spark)}/filings-{uuid.uuid4().hex}"
    pages = loader(spark, d)("pages")
    found = F.when(F.col("page_id") % 11 != 5, F.concat(F.lit("<p>filing</p>"), F.coalesce("html", F.lit(""))))
    rows = pages.select(F.col("page_id").alias("filing_id"), (F.col("page_id") % 7).alias("company_id"), F.lit("8-K").alias("form"), F.concat(F.lit("files/"), F.col("page_id").cast("string"), F.lit(".htm")).alias("path"), found.alias("html"))
    companies = loader(spark, d)("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), *[F.lit(None).cast(t).alias(c) for c, t in (("symbols", "array<string>"), ("exchanges", "array<string>"), ("sector", "string"), ("industry", "string"))])
    source.register(spark)
    job = FilingIngest(spark, f"{at}/out", companies)
    for run in (0, 1):
        source.export(rows.where(F.col("filing_id") % 3 == 0) if run == 0 else rows.where(F.col("filing_id") % 3 != 0), f"{at}/in", f"m{run}")
        job.run(spark.readStream.format("filings").load(f"{at}/in"))
    count = job.read("filing_pages").groupBy("filing_id").agg(F.count("*").alias("pages"))
    failed = job.read("filing_errors").select("filing_id", F.col("step").alias("failed"))
    out = job.read("filings").join(failed, "filing_id", "left").join(count, "filing_id", "left")
    return out.select("filing_id", "num_pages", "synced", "failed", F.coalesce("pages", F.lit(0)).cast("long").alias("pages"))
