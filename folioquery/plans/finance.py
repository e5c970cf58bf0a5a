"""Financial statements, on facts derived from orders: year and quarter of the order date, one concept a status and priority."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import statements as st
from .fixtures import loader
from .registry import query

_QUARTER = "SELECT year(o_orderdate) AS fy, quarter(o_orderdate) AS q, o_orderstatus AS concept, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS v FROM orders GROUP BY ALL"


def facts(spark, d, ytd: bool = False, quarters: tuple[int, ...] = (1, 2, 3, 4), annual: bool = False):
    """Long facts: (fiscal_year, fiscal_period, concept, value). ``ytd`` accumulates within a year; Q4 is left out of ``quarters`` to be inferred."""
    orders = loader(spark, d)("orders").select(F.year("o_orderdate").cast("long").alias("fiscal_year"), F.quarter("o_orderdate").alias("q"), F.col("o_orderstatus").alias("concept"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    base = orders.groupBy("fiscal_year", "q", "concept").agg(F.sum("v").alias("v"))
    # each quarter's sum goes to every period that holds it; 5 is the year
    periods = F.explode(F.array(*map(F.lit, [*quarters, *([5] if annual else [])]))).alias("p")
    held = (F.col("p") == 5) | (F.col("q") <= F.col("p") if ytd else F.col("q") == F.col("p"))
    rows = base.select("fiscal_year", "concept", periods, "q", "v").where(held).groupBy("fiscal_year", F.col("p").alias("q"), "concept").agg(F.sum("v").alias("v"))
    year, whole = F.col("fiscal_year").cast("int"), F.col("q") == 5
    day = lambda month: F.make_date(year, month, F.lit(1))
    first = day(F.when(whole, 1).otherwise(F.lit(1) if ytd else F.col("q") * 3 - 2))
    rows = rows.select("fiscal_year", F.when(whole, "FY").otherwise(F.concat(F.lit("Q"), "q")).alias("fiscal_period"), "concept", "v", first.alias("start_date"), F.last_day(day(F.when(whole, 12).otherwise(F.col("q") * 3))).alias("report_date"))
    number = F.when(F.col("fiscal_period") == "FY", 5).otherwise(F.substring("fiscal_period", 2, 1).try_cast("int"))
    return st.fill_defaults(rows.select(F.lit(1).cast("long").alias("company_id"), (F.col("fiscal_year") * 10 + number).cast("long").alias("statement_id"), "fiscal_year", "fiscal_period", "report_date", "start_date", F.col("report_date").alias("filing_date"), "concept", F.concat(F.lit("Status "), "concept").alias("label"), F.ascii("concept").alias("position"), F.lit("duration").alias("period"), F.lit("10-Q").alias("form"), F.col("v").cast("double").alias("value")))


@query(f"SELECT fy AS fiscal_year, 'Q' || q AS fiscal_period, concept, CAST(v AS DOUBLE) AS value FROM ({_QUARTER})")
def stmt_facts(spark, d):
    return facts(spark, d).select("fiscal_year", "fiscal_period", "concept", "value")


@query(f"SELECT concept, 'Status ' || concept AS label, fy || ' FY' AS period, CAST(sum(v) AS DOUBLE) AS value FROM ({_QUARTER}) GROUP BY fy, concept")
def stmt_annual_merge(spark, d):
    rows = st.select_statements(facts(spark, d, annual=True).withColumn("form", F.lit("10-K")), "annual")
    return st.merge_periods(rows).select("concept", "label", F.col("column").alias("period"), "value")


_NULLED = "SELECT fy, CASE WHEN concept <> 'P' THEN concept END AS concept, CASE WHEN fy % 2 = 0 THEN 1 END AS company_id, v"


@query(f"SELECT company_id, concept, '' AS axis, '' AS member, fy || ' FY' AS period, CAST(sum(v) AS DOUBLE) AS value FROM ({_NULLED} FROM ({_QUARTER})) GROUP BY fy, concept, company_id")
def stmt_merge_nulls(spark, d):
    """Facts without axis, member and dimension, some without a concept or a company: none of them is lost."""
    rows = st.select_statements(facts(spark, d, annual=True).withColumn("form", F.lit("10-K")), "annual")
    none = F.lit(None).cast("string")
    rows = rows.withColumns({"axis": none, "member": none, "dimension": F.lit(None).cast("boolean"), "concept": F.when(F.col("concept") != "P", F.col("concept")), "company_id": F.when(F.col("fiscal_year") % 2 == 0, F.col("company_id").cast("int"))})
    return st.merge_periods(rows).select("company_id", "concept", "axis", "member", F.col("column").alias("period"), "value")


@query(f"""
WITH years AS (SELECT fy FROM ({_QUARTER}) WHERE q < 4 GROUP BY fy HAVING count(DISTINCT q) = 3)
SELECT fy AS fiscal_year, concept, CASE WHEN count(*) FILTER (WHERE q < 4) = 3 THEN round(coalesce(sum(v) FILTER (WHERE q = 4), 0), 2)::DOUBLE END AS value
FROM ({_QUARTER}) WHERE fy IN (SELECT fy FROM years) GROUP BY fy, concept
""")
def stmt_q4_nulls(spark, d):
    """A company without an id has its fourth quarters too."""
    rows = facts(spark, d, quarters=(1, 2, 3), annual=True).withColumns({"company_id": F.lit(None).cast("long"), "axis": F.lit(None).cast("string")})
    return st.infer_q4(rows).select("fiscal_year", "concept", (F.round("value", 2) + 0.0).alias("value"))


@query(f"SELECT concept, 'Status ' || concept AS label, DATE '1995-12-31' AS report_date, CAST(sum(v) FILTER (WHERE fy = 1995) AS DOUBLE) AS value FROM ({_QUARTER}) GROUP BY concept")
def stmt_current_period(spark, d):
    """A reported statement with several columns of values, of which the one of its own period counts."""
    f = facts(spark, d)
    year = lambda y: F.sum(F.when(F.col("fiscal_year") == y, F.col("value").cast("decimal(18,2)"))).cast("double").cast("string")
    wide = f.groupBy("concept", "label").agg(year(1994).alias("1994"), year(1995).alias("1995-01-01_1995-12-31"), year(1993).alias("1993-01-01_1993-12-31"))
    return st.current_period(wide, F.lit("1995-12-31").cast("date")).select("concept", "label", "report_date", "value")


@query(f"SELECT concept, 'Status ' || concept AS label, CAST(fy AS VARCHAR) AS report_date, CAST(sum(v) AS DOUBLE) AS value FROM ({_QUARTER}) WHERE fy IN (1994, 1995) GROUP BY concept, fy")
def stmt_unpivot(spark, d):
    """A table with one column a period as long facts; periods without a value stay out."""
    f = facts(spark, d)
    year = lambda y: F.sum(F.when(F.col("fiscal_year") == y, F.col("value").cast("decimal(18,2)"))).cast("double").alias(str(y))
    wide = f.groupBy("concept", "label").agg(year(1994), year(1995), year(1900))
    return st.unpivot_statement(wide, ["concept", "label"], ["1994", "1995", "1900"])


_YEARS = list(range(1992, 1999))
_PIVOT = ", ".join(f'CAST(sum(v) FILTER (WHERE fy = {y}) AS DOUBLE) AS "{y} FY"' for y in _YEARS)


@query(f"SELECT concept, {_PIVOT} FROM ({_QUARTER}) GROUP BY concept")
def stmt_pivot(spark, d):
    rows = st.merge_periods(facts(spark, d, annual=True).where("fiscal_period = 'FY'"))
    return st.pivot(rows, [f"{y} FY" for y in _YEARS]).select("concept", *[f"{y} FY" for y in _YEARS])


@query(f"""
WITH f AS ({_QUARTER}), k AS (SELECT DISTINCT fy, concept FROM f),
y AS (SELECT k.fy, p AS q, k.concept, sum(v) AS ytd FROM k, (SELECT unnest([1, 2, 3]) AS p) JOIN f ON f.fy = k.fy AND f.concept = k.concept AND f.q <= p GROUP BY ALL)
SELECT fy AS fiscal_year, 'Q' || q AS fiscal_period, concept,
       round(CASE WHEN q = 1 THEN ytd WHEN lag(q) OVER w = q - 1 THEN ytd - lag(ytd) OVER w
            WHEN EXISTS (SELECT 1 FROM y z WHERE z.fy = y.fy AND z.q = y.q - 1) THEN NULL ELSE ytd END, 2)::DOUBLE AS value
FROM y WINDOW w AS (PARTITION BY fy, concept ORDER BY q)
""")
def stmt_ytd_to_quarter(spark, d):
    """Q3 - Q2 of year-to-date values, which is the third quarter itself."""
    rows = st.is_ytd(facts(spark, d, ytd=True, quarters=(1, 2, 3)))
    return st.ytd_to_quarter(rows).select("fiscal_year", "fiscal_period", "concept", F.round("value", 2).alias("value"))


@query(f"""
WITH f AS ({_QUARTER}), years AS (SELECT fy FROM f WHERE q < 4 GROUP BY fy HAVING count(DISTINCT q) = 3)
SELECT fy AS fiscal_year, concept,
       CASE WHEN count(*) FILTER (WHERE q < 4) = 3 THEN round(coalesce(sum(v) FILTER (WHERE q = 4), 0), 2)::DOUBLE END AS value
FROM f WHERE fy IN (SELECT fy FROM years) GROUP BY fy, concept
""")
def stmt_q4_infer(spark, d):
    """FY less three quarters equals the fourth quarter's own sum."""
    rows = st.infer_q4(facts(spark, d, quarters=(1, 2, 3), annual=True))
    return rows.select("fiscal_year", "concept", (F.round("value", 2) + 0.0).alias("value"))


@query(f"""
WITH f AS ({_QUARTER}), years AS (SELECT fy FROM f WHERE q < 4 GROUP BY fy HAVING count(DISTINCT q) = 3)
SELECT fy AS fiscal_year, 'Q' || q AS fiscal_period, concept, round(v, 2)::DOUBLE AS value
FROM f WHERE fy BETWEEN 1993 AND 1995 AND (q < 4 OR (fy IN (SELECT fy FROM years)))
""")
def stmt_quarterly_view(spark, d):
    """Year-to-date filings in, quarters with an inferred Q4 out, within a range of report dates."""
    rows = facts(spark, d, ytd=True, quarters=(1, 2, 3), annual=True)
    heads = rows.select("statement_id", "company_id", "fiscal_year", "fiscal_period", "start_date", "filing_date").distinct()
    out = st.quarterly(rows, heads, "1993-01-01", "1995-12-31")
    return out.select("fiscal_year", "fiscal_period", "concept", F.round("value", 2).alias("value"))


@query("""
SELECT o_orderkey, CASE WHEN v = 0 THEN '-' WHEN abs(v) >= 1e9 THEN format('${:.3f}B', v / 1e9) WHEN abs(v) >= 1e6 THEN format('${:.3f}M', v / 1e6)
  WHEN abs(v) >= 1e3 THEN format('${:.3f}K', v / 1e3) ELSE format('${:.3f}', v) END AS shown
FROM (SELECT o_orderkey, (CAST(o_totalprice AS BIGINT) - 40000) * (CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 100000 END)::DOUBLE AS v FROM orders)
""")
def stmt_format(spark, d):
    scale = F.when(F.col("o_orderkey") % 3 == 0, 1.0).when(F.col("o_orderkey") % 3 == 1, 1000.0).otherwise(100000.0)
    v = (F.rint("o_totalprice").cast("long") - 40000) * scale
    return loader(spark, d)("orders").select("o_orderkey", tx.format_value(v).alias("shown"))


@query("""
SELECT c_custkey, CASE WHEN v = 0 THEN 'N/A' WHEN abs(v) >= 1e12 THEN format('${:.1f}T', v / 1e12) WHEN abs(v) >= 1e9 THEN format('${:.1f}B', v / 1e9)
  WHEN abs(v) >= 1e6 THEN format('${:.1f}M', v / 1e6) ELSE format('${:.1f}', v) END AS shown
FROM (SELECT c_custkey, floor(c_acctbal) * power(1000, c_custkey % 4) + 0.26 AS v FROM customer)
""")
def market_cap_format(spark, d):
    v = F.floor("c_acctbal").cast("double") * F.pow(F.lit(1000.0), F.col("c_custkey") % 4) + 0.26
    return loader(spark, d)("customer").select("c_custkey", tx.format_market_cap(v).alias("shown"))


@query("""
WITH price AS (SELECT * FROM (VALUES ('a', 1.25, 10.0, 0.125), ('b', 3.0, 15.0, 0.3)) t(model, i, o, c)),
u AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS model, user_id % 10 AS grp, event_id * 7 % 1000 AS tin, event_id * 3 % 500 AS tout, event_id % 100 AS cached FROM events)
SELECT model, grp, CAST(sum(tin) AS BIGINT) AS input_tokens, CAST(sum(tout) AS BIGINT) AS output_tokens,
       round((sum(tin) * i + sum(cached) * c + sum(tout) * o) / 1e6, 6)::DOUBLE AS cost
FROM u JOIN price USING (model) GROUP BY model, grp, i, o, c
""")
def cost_rollup(spark, d):
    """Token sums and their cost; prices come per million, with a tier for cached input."""
    price = spark.createDataFrame([("a", 1.25, 10.0, 0.125), ("b", 3.0, 15.0, 0.3)], "model string, i double, o double, c double")
    e = F.col("event_id")
    use = loader(spark, d)("events").select(F.when(e % 2 == 0, "a").otherwise("b").alias("model"), (F.col("user_id") % 10).alias("grp"), (e * 7 % 1000).alias("tin"), (e * 3 % 500).alias("tout"), (e % 100).alias("cached"))
    total = use.groupBy("model", "grp").agg(F.sum("tin").alias("input_tokens"), F.sum("tout").alias("output_tokens"), F.sum("cached").alias("cached"))
    cost = (F.col("input_tokens") * F.col("i") + F.col("cached") * F.col("c") + F.col("output_tokens") * F.col("o")) / 1e6
    return total.join(F.broadcast(price), "model").select("model", "grp", "input_tokens", "output_tokens", F.round(cost, 6).alias("cost"))


_EVAL = "SELECT event_id AS id, 'q' || event_id AS question, CASE WHEN event_id % 4 = 0 THEN 'r' || event_id END AS revised, 't' || event_id AS truth, CASE WHEN event_id % 3 = 0 THEN 'o' || event_id END AS original, ['none', 'outdated', 'added_precision', 'incorrect_answer', 'structurally_invalid'][event_id % 5 + 1] AS issue FROM events"


@query(f"""
SELECT mode, id,
  CASE mode WHEN 'strict' THEN coalesce(revised, question) WHEN 'standard' THEN CASE WHEN issue = 'structurally_invalid' THEN coalesce(revised, question) ELSE question END ELSE question END AS question,
  CASE WHEN mode = 'strict' OR (mode = 'updated' AND issue IN ('outdated', 'added_precision')) OR (mode = 'standard' AND issue IN ('outdated', 'incorrect_answer', 'structurally_invalid')) THEN truth ELSE coalesce(original, truth) END AS ground_truth
FROM ({_EVAL}), (SELECT unnest(['original', 'updated', 'standard', 'strict']) AS mode)
""")
def eval_mode_select(spark, d):
    from ..sources.evals import select_mode

    e = F.col("event_id")
    names = F.array(*map(F.lit, ("none", "outdated", "added_precision", "incorrect_answer", "structurally_invalid")))
    key = lambda p: F.concat(F.lit(p), e.cast("string"))
    rows = loader(spark, d)("events").select(e.alias("id"), key("q").alias("question"), F.when(e % 4 == 0, key("r")).alias("revised_question"), key("t").alias("ground_truth"), F.when(e % 3 == 0, key("o")).alias("original_ground_truth"), F.get(names, (e % 5).cast("int")).alias("issue_type"))
    out = None
    for mode in ("original", "updated", "standard", "strict"):
        one = select_mode(rows, mode).select(F.lit(mode).alias("mode"), "id", "question", "ground_truth")
        out = one if out is None else out.unionByName(one)
    return out


@query("""
SELECT event_type, count(*) AS questions, CAST(sum(CAST(value > 50 AS INT)) AS BIGINT) AS correct, round(avg(CAST(value > 50 AS INT)), 6) AS accuracy,
       round(avg(CAST(value AS DECIMAL(18, 6))), 4)::DOUBLE AS avg_time, CAST(median(user_id) AS DOUBLE) AS p50_user
FROM events GROUP BY event_type
""")
def eval_summary(spark, d):
    right = (F.col("value") > 50).cast("int")
    return loader(spark, d)("events").groupBy("event_type").agg(F.count("*").alias("questions"), F.sum(right).alias("correct"), F.round(F.avg(right), 6).alias("accuracy"), F.round(F.avg(F.col("value").cast("decimal(18,6)")).cast("decimal(22,4)").cast("double"), 4).alias("avg_time"), F.median("user_id").alias("p50_user"))
