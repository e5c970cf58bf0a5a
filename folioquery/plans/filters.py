"""Predicates, projection, order, counts, views and key joins."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators.predicates import Leaf
from .fixtures import database, loader
from .registry import query


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def pred_eq(spark, d):
    return database(spark, d).table("orders").eq("o_orderpriority", "1-URGENT").select("o_orderkey, o_custkey").frame()


@query("SELECT d.doc_id AS id, quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE quality <> 1")
def pred_neq(spark, d):
    return database(spark, d).table("labelled_docs").neq("quality", 1).select("id", "quality").frame()


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 AND o_totalprice >= 1000.5 AND o_totalprice < 90000 AND o_totalprice <= 80000")
def pred_gt_gte_lt_lte(spark, d):
    t = database(spark, d).table("orders").gt("o_totalprice", 1000.0).gte("o_totalprice", 1000.5).lt("o_totalprice", 90000.0).lte("o_totalprice", 80000.0)
    return t.gt("o_custkey", None).select("o_orderkey", "o_totalprice").frame()


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')")
def pred_in(spark, d):
    return database(spark, d).table("orders").in_("o_orderstatus", ["F", "P"]).select("o_orderkey").frame()


@query("SELECT o_orderkey FROM orders WHERE false")
def pred_in_empty(spark, d):
    return database(spark, d).table("orders").in_("o_orderstatus", []).select("o_orderkey").frame()


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT range * 2 FROM range(1200))")
def pred_in_large(spark, d):
    return database(spark, d).table("orders").in_("o_custkey", range(0, 2400, 2)).select("o_orderkey").frame()


@query("SELECT d.doc_id AS id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE quality NOT IN (0)")
def pred_not_in(spark, d):
    return database(spark, d).table("labelled_docs").not_in("quality", [0]).select("id").frame()


@query("SELECT d.doc_id AS id FROM documents d LEFT JOIN labels l USING (doc_id)")
def pred_not_in_empty(spark, d):
    return database(spark, d).table("labelled_docs").not_in("quality", []).select("id").frame()


@query("SELECT d.doc_id AS id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE quality NOT IN (0, NULL)")
def pred_not_in_null(spark, d):
    return database(spark, d).table("labelled_docs").not_in("quality", [0, None]).select("id").frame()


@query("SELECT d.doc_id AS id, lang FROM documents d LEFT JOIN labels l USING (doc_id) WHERE quality IS NULL")
def pred_is_null(spark, d):
    return database(spark, d).table("labelled_docs").is_null("quality").select("id", "lang").frame()


@query("SELECT d.doc_id AS id, toxic FROM documents d LEFT JOIN labels l USING (doc_id) WHERE toxic IS NOT NULL")
def pred_is_not_null(spark, d):
    return database(spark, d).table("labelled_docs").is_not_null("toxic").select("id", "toxic").frame()


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01' AND o_totalprice <= 50000")
def pred_between_open(spark, d):
    t = database(spark, d).table("orders").between("o_orderdate", datetime(1995, 6, 1), None).between("o_totalprice", None, 50000.0).between("o_custkey", None, None)
    return t.select("o_orderkey").frame()


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR (o_totalprice > 200000 AND o_orderpriority <> '5-LOW')")
def pred_or(spark, d):
    either = Leaf("eq", "o_orderstatus", "P") | (Leaf("gt", "o_totalprice", 200000.0) & Leaf("neq", "o_orderpriority", "5-LOW"))
    return database(spark, d).table("orders").where(either).select("o_orderkey").frame()


_TAGS = "(SELECT o_custkey AS c_custkey, list(DISTINCT o_orderstatus) AS tags, list(DISTINCT year(o_orderdate)) AS years FROM orders GROUP BY 1)"


@query(f"SELECT c_custkey FROM {_TAGS} WHERE list_contains(tags, 'P')")
def pred_contains_array(spark, d):
    return database(spark, d).table("customer_tags").contains("tags", "P").select("c_custkey").frame()


@query(f"SELECT c_custkey FROM {_TAGS} WHERE list_has_any(years, [1992, 1998])")
def pred_contains_any(spark, d):
    return database(spark, d).table("customer_tags").contains("years", [1992, 1998, "1995"]).select("c_custkey").frame()


@query("SELECT event_id FROM events WHERE props LIKE '{%' AND regexp_matches(props, '\"k\"\\s*:')")
def pred_contains_key(spark, d):
    return database(spark, d).table("events").contains("props", ["k", "absent"]).select("event_id").frame()


@query("SELECT p_partkey, p_name FROM part WHERE translate(p_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%an%'")
def pred_ilike(spark, d):
    return database(spark, d).table("part").ilike("p_name", "AN").select("p_partkey", "p_name").frame()


@query("SELECT p_partkey FROM part WHERE translate(p_type, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE 'st%'")
def pred_ilike_prefix(spark, d):
    return database(spark, d).table("part").ilike_prefix("p_type", "ST").select("p_partkey").frame()


@query("SELECT doc_id FROM documents WHERE regexp_matches(coalesce(text, ''), '(?i)th(e|at)\\s+an')")
def pred_regex(spark, d):
    return database(spark, d).table("documents").regex("text", r"th(e|at)\s+an").select("doc_id").frame()


@query("SELECT o_orderkey, upper(o_orderstatus) AS s, length(o_orderpriority) AS n FROM orders WHERE o_totalprice > 100000")
def select_expr(spark, d):
    return database(spark, d).table("orders").gt("o_totalprice", 100000.0).select("o_orderkey", "upper(o_orderstatus) AS s", "cast(length(o_orderpriority) as bigint) AS n").frame()


@query("SELECT count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM orders WHERE o_orderstatus = 'F'")
def select_aggregate(spark, d):
    return database(spark, d).table("orders").eq("o_orderstatus", "F").select("count(*) AS n", "cast(sum(cast(o_totalprice as decimal(18,2))) as double) AS total").frame()


@query("SELECT d.doc_id AS id, quality FROM documents d LEFT JOIN labels l USING (doc_id) ORDER BY quality ASC NULLS FIRST, d.doc_id DESC LIMIT 40")
def order_nulls(spark, d):
    return database(spark, d).table("labelled_docs").order("quality").order("id", desc=True).limit(10).limit(40).select("id", "quality").frame()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def limit_topk(spark, d):
    return database(spark, d).table("orders").order("o_totalprice", desc=True).order("o_orderkey").limit(25).select("o_orderkey", "o_totalprice").frame()


@query("SELECT count(*) AS count FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 10000")
def count_where(spark, d):
    return database(spark, d).table("orders").eq("o_orderstatus", "O").gt("o_totalprice", 10000.0).order("o_orderkey").limit(3).count()


@query("SELECT o_orderkey AS id, o_totalprice AS amount, c_name AS company_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def view_two_way(spark, d):
    return database(spark, d).table("filings_view").eq("company_sector", "BUILDING").select("id", "amount", "company_name").frame()


@query("SELECT o_orderkey AS id, n_name AS country FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def view_three_way(spark, d):
    return database(spark, d).table("filings_by_country").select("id", "country").frame()


@query("SELECT o_orderkey AS id, c_name AS company_name, n_name AS country, r_name AS region FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')")
def view_four_way(spark, d):
    return database(spark, d).table("filings_by_region").in_("region", ["ASIA", "EUROPE"]).select("id", "company_name", "country", "region").frame()


@query("SELECT o_orderkey AS id, o_totalprice AS amount FROM orders WHERE o_orderpriority = '2-HIGH'")
def view_pruned(spark, d):
    """Only the base is read: no column of the joined tables is used."""
    return database(spark, d).table("filings_by_region").eq("form", "2-HIGH").select("id", "amount").frame()


@query("SELECT c_custkey AS company_id, c_name AS company_name, o_orderkey AS filing_id FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def view_parent_to_child(spark, d):
    return database(spark, d).table("companies_with_filings").frame()


@query("SELECT l_orderkey AS filing_id, l_linenumber AS page, c_name AS company_name FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey WHERE l_linenumber = 1")
def view_pages(spark, d):
    return database(spark, d).table("pages_view").eq("page", 1).select("filing_id", "page", "company_name").frame()


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (1, 2, 3, 5, 7, 33)")
def fetch_by_key(spark, d):
    return database(spark, d).fetch_by_key("orders", [1, 2, 3, 5, 7, 33]).select("o_orderkey", "o_orderstatus")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
def join_semi_ids(spark, d):
    load = loader(spark, d)
    return load("customer").join(load("orders").where("o_totalprice > 150000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def join_anti_incremental(spark, d):
    load = loader(spark, d)
    return load("orders").join(load("lineitem").where("l_quantity > 45"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT coalesce(a.n_nationkey, b.n_nationkey) AS nation, coalesce(a.n, 0) AS customers, coalesce(b.n, 0) AS suppliers FROM (SELECT c_nationkey AS n_nationkey, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS n_nationkey, count(*) AS n FROM supplier GROUP BY 1) b ON a.n_nationkey = b.n_nationkey")
def join_full_coalesce(spark, d):
    load = loader(spark, d)
    a = load("customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    b = load("supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "nation", "full").select("nation", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("SELECT o_custkey AS c, string_agg(o_orderkey::VARCHAR, ' ' ORDER BY o_orderkey) AS filings FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def group_children(spark, d):
    """Children grouped under their parent, in order; a parent has few children here."""
    rows = loader(spark, d)("orders").where("o_totalprice > 100000")
    return rows.groupBy(F.col("o_custkey").alias("c")).agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>"), " ").alias("filings"))
