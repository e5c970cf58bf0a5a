import datetime as dt

from folioquery.operators import statements as st

D = dt.date


def facts(spark):
    rows = []
    for period, day, ytd in (("Q1", D(2024, 3, 31), 10.0), ("Q2", D(2024, 6, 30), 30.0), ("Q3", D(2024, 9, 30), 60.0), ("FY", D(2024, 12, 31), 100.0)):
        rows.append((1, {"Q1": 1, "Q2": 2, "Q3": 3, "FY": 4}[period], 2024, period, day, D(2024, 1, 1), day, "Revenue", "Revenue", 0, "duration", ytd))
        rows.append((1, {"Q1": 1, "Q2": 2, "Q3": 3, "FY": 4}[period], 2024, period, day, D(2024, 1, 1), day, "Cash", "Cash", 1, "instant", ytd + 1))
    return spark.createDataFrame(rows, "company_id long, statement_id long, fiscal_year int, fiscal_period string, report_date date, start_date date, filing_date date, concept string, label string, position int, period string, value double")


def test_quarters_add_up_to_the_year(spark):
    f = facts(spark)
    heads = f.select("statement_id", "company_id", "fiscal_year", "fiscal_period", "start_date", "filing_date").distinct()
    got = {(r.concept, r.fiscal_period): r.value for r in st.quarterly(f, heads, "2024-01-01", "2024-12-31").collect()}
    assert [got["Revenue", q] for q in ("Q1", "Q2", "Q3", "Q4")] == [10.0, 20.0, 30.0, 40.0]
    assert [got["Cash", q] for q in ("Q1", "Q2", "Q3", "Q4")] == [11.0, 31.0, 61.0, 101.0]


def test_missing_quarter(spark):
    f = st.fill_defaults(facts(spark))
    assert st.infer_q4(f.where("fiscal_period <> 'Q2'")).count() == 0
    part = f.where("NOT (fiscal_period = 'Q2' AND concept = 'Revenue')")
    assert {r.concept: r.value for r in st.infer_q4(part).collect()} == {"Revenue": None, "Cash": 101.0}
    lone = st.is_ytd(f.where("fiscal_period IN ('Q1', 'Q3')"))
    kept = {(r.concept, r.fiscal_period): r.value for r in st.ytd_to_quarter(lone).collect()}
    assert kept["Revenue", "Q3"] == 60.0


def test_amendment_wins(spark):
    s = spark.createDataFrame([(1, 1, 2024, "Q1", D(2024, 4, 1)), (2, 1, 2024, "Q1", D(2024, 5, 1))], "statement_id long, company_id long, fiscal_year int, fiscal_period string, filing_date date")
    assert [r.statement_id for r in st.latest_statements(s).collect()] == [2]


def test_render_and_forms(spark):
    merged = st.merge_periods(st.fill_defaults(facts(spark)))
    rows = st.pivot(merged, ["2024 Q1", "2024 FY"]).collect()
    assert [r.concept for r in rows] == ["Cash", "Revenue"] or [r.concept for r in rows] == ["Revenue", "Cash"]
    assert "$100.000" in st.render(rows, ["2024 Q1", "2024 FY"])
    s = spark.createDataFrame([("10-K", "FY", "United States"), ("10-Q", "Q1", "United States"), ("10-Q", "Q2", "Canada")], "form string, fiscal_period string, country string")
    from pyspark.sql import functions as F

    assert st.select_statements(s, "annual").count() == 1
    assert st.select_statements(s, "quarterly", F.col("country")).count() == 1
    wide = spark.createDataFrame([("Rev", 1.0, None)], "concept string, a double, b double")
    assert st.unpivot_statement(wide, ["concept"], ["a", "b"]).count() == 1
