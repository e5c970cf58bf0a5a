"""Financial statements as long facts: one row a (statement, concept, axis, member).

A fact's key is (concept, dimension, axis, member). Period arithmetic is windows and conditional aggregates over
(company, key); only display pivots.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["concept", "dimension", "axis", "member"]
QUARTERS = ("Q1", "Q2", "Q3")


def fill_defaults(facts: DataFrame) -> DataFrame:
    """Missing metadata: empty axis, member and period, level 0, not abstract, no dimension."""
    blank = {"axis": "", "member": "", "period": "", "level": 0, "abstract": False, "dimension": False}
    out = facts
    for name, value in blank.items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in facts.columns else F.lit(value))
    return out


def without_segments(facts: DataFrame) -> DataFrame:
    return facts.where(~F.col("dimension"))


def latest_statements(statements: DataFrame, by: Sequence[str] = ("company_id", "fiscal_year", "fiscal_period"), order: Sequence[str] = ("filing_date", "statement_id")) -> DataFrame:
    """One statement for each year and period: the last filed wins."""
    w = W.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return statements.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def period_label() -> Column:
    """Year and period, or the report date where either is missing."""
    whole = F.col("fiscal_year").isNotNull() & F.col("fiscal_period").isNotNull() & (F.col("fiscal_period") != "")
    return F.when(whole, F.concat_ws(" ", F.col("fiscal_year").cast("string"), "fiscal_period")).otherwise(F.col("report_date").cast("string"))


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of which any may be null: nulls are equal. The left side's keys stay."""
    other = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    met = left.join(other, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in keys)), how)
    return met.drop(*[f"__r_{c}" for c in keys])


def merge_periods(facts: DataFrame) -> DataFrame:
    """Long form of the merged view: each key and period label once; label and level from the first statement that has the
    key, ``first_seen`` orders keys by first appearance. Missing metadata is filled first; a null company or concept is one of its own."""
    facts = fill_defaults(facts)
    first = F.min_by(F.struct("label", "level"), F.struct("report_date", "statement_id")).alias("head")
    seen = facts.groupBy("company_id", *KEY).agg(first, F.min(F.struct("report_date", "statement_id", "position")).alias("first_seen"))
    labelled = facts.withColumn("column", period_label())
    values = labelled.groupBy("company_id", *KEY, "column").agg(F.max_by("value", F.struct("report_date", "statement_id")).alias("value"), F.max("report_date").alias("report_date"))
    return _same(values, seen, ["company_id", *KEY]).select("company_id", *KEY, "head.label", "head.level", "first_seen", "column", "report_date", "value")


def pivot(merged: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One column a period, for the stated labels; rows in order of first appearance."""
    wide = merged.groupBy("company_id", *KEY, "label", "level", "first_seen").pivot("column", list(columns)).agg(F.first("value"))
    return wide.orderBy("company_id", "first_seen", *KEY).drop("first_seen")


def is_ytd(statements: DataFrame) -> DataFrame:
    """Statements with ``ytd``: the period starts at the fiscal year's start, which only a Q1 statement tells."""
    start = F.min(F.when(F.col("fiscal_period") == "Q1", F.col("start_date"))).over(W.partitionBy("company_id", "fiscal_year"))
    return statements.withColumn("ytd", F.coalesce(F.col("fiscal_period").isin("Q2", "Q3") & (F.col("start_date") == start), F.lit(False)))


def ytd_to_quarter(facts: DataFrame) -> DataFrame:
    """Year-to-date durations to quarters: Q2 - Q1 and Q3 - Q2 (year to date); instants stay.

    A quarter whose predecessor's statement is missing keeps its year-to-date value; a key missing from the predecessor becomes null.
    (Some systems subtract the already normalised Q2 from Q3, which leaves Q1 + Q3; this does not.)
    """
    q = F.substring("fiscal_period", 2, 1).try_cast("int")
    facts = facts.withColumn("__q", q)
    prior = F.col("__q") - 1
    have = F.array_contains(F.collect_set("__q").over(W.partitionBy("company_id", "fiscal_year")), prior)
    facts = facts.withColumn("__have", F.coalesce(have, F.lit(False)))
    key = W.partitionBy("company_id", "fiscal_year", *KEY).orderBy("__q")  # within the partitioning of the window above
    before = F.when(F.lag("__q").over(key) == prior, F.lag("value").over(key))
    change = F.col("ytd") & F.col("__have") & (F.col("period") == "duration")
    return facts.withColumn("__before", before).withColumn("value", F.when(change, F.col("value") - F.col("__before")).otherwise(F.col("value"))).drop("__q", "__have", "__before")


_SHARED = ["company_id", "fiscal_year", "fiscal_period", "report_date", *KEY, "label", "level", "period", "value"]


def _by_key(facts: DataFrame) -> DataFrame:
    """One row a (company, year, key): ``rows``, its facts but for FY, and ``q4``, the inferred fact or null."""
    periods = F.collect_set("fiscal_period").over(W.partitionBy("company_id", "fiscal_year"))
    marked = facts.withColumn("__whole", F.size(F.array_intersect(periods, F.array(*map(F.lit, ("FY", *QUARTERS))))) == 4)
    own = ["fiscal_period", "report_date", "label", "level", "period", "value"]
    of = lambda p, c="value": F.max(F.when(F.col("fiscal_period") == p, F.col(c)))
    got = marked.groupBy("company_id", "fiscal_year", *KEY).agg(
        F.collect_list(F.when(F.col("fiscal_period") != "FY", F.struct(*own))).alias("rows"),
        *[of(q).alias(f"__{q}") for q in QUARTERS],
        *[of("FY", c).alias(f"__{c}") for c in own[1:]],
        F.max(F.col("__whole") & (F.col("fiscal_period") == "FY")).alias("__in"),
    )
    fy = F.col("__value")
    value = F.when(F.col("__period") == "duration", fy - F.col("__Q1") - F.col("__Q2") - F.col("__Q3")).when(F.col("__period") == "instant", fy)
    q4 = F.struct(F.lit("Q4").alias("fiscal_period"), F.col("__report_date").alias("report_date"), F.col("__label").alias("label"), F.col("__level").alias("level"), F.col("__period").alias("period"), value.alias("value"))
    return got.select("company_id", "fiscal_year", *KEY, "rows", F.when(F.col("__in"), q4).alias("q4"))


def infer_q4(facts: DataFrame) -> DataFrame:
    """Q4 facts of years that have FY and Q1 to Q3: durations FY - Q1 - Q2 - Q3 (null if any is missing), instants FY, others null."""
    got = _by_key(facts).where("q4 IS NOT NULL")
    return got.select("company_id", "fiscal_year", "q4.fiscal_period", "q4.report_date", *KEY, "q4.label", "q4.level", "q4.period", "q4.value", F.lit("inferred").alias("form"))


def in_range(facts: DataFrame, start: str, end: str) -> DataFrame:
    """Inclusive on the report date; applied after inference."""
    return facts.where(F.col("report_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def lookback(start: Column) -> Column:
    """Quarterly views load a year more, for differences."""
    return F.date_sub(start, 365)


def select_statements(statements: DataFrame, kind: str, country: Column | None = None) -> DataFrame:
    """Annual: FY of annual forms. Quarterly: the rest, and none for companies outside the United States."""
    # Annual forms.
    annual = F.col("form").isin("10-K", "10-K/A", "20-F", "20-F/A") & (F.col("fiscal_period") == "FY")
    if kind == "annual":
        return statements.where(annual)
    domestic = F.lit(True) if country is None else F.coalesce(country == "United States", F.lit(False))
    return statements.where((F.col("fiscal_period") != "FY") & domestic)


def quarterly(facts: DataFrame, statements: DataFrame, start: str, end: str) -> DataFrame:
    """Quarter facts within a range: latest statement of each period, year to date undone, Q4 inferred. One join, and one partitioning by company and year
    for all that follows.

    Facts from a year before the range are read too: a quarter of year-to-date values needs its predecessor, and a Q4 the three before it.
    """
    loaded = F.col("report_date").between(lookback(F.lit(start).cast("date")), F.lit(end).cast("date"))
    chosen = is_ytd(latest_statements(statements)).select("statement_id", "ytd")
    rows = fill_defaults(facts.where(loaded)).join(chosen, "statement_id")
    rows = ytd_to_quarter(rows.where(F.col("fiscal_period").isin("FY", *QUARTERS)))  # a year's row has no quarter before it and stays
    every = _by_key(rows).withColumn("f", F.explode(F.concat("rows", F.when(F.col("q4").isNotNull(), F.array("q4")).otherwise(F.array()))))
    return in_range(every.select("company_id", "fiscal_year", *KEY, "f.*").select(*_SHARED), start, end)


#: Columns of a statement that are no periods.
META = ("concept", "label", "abstract", "dimension", "axis", "member", "period", "level")


def value_column(columns: Sequence[str], meta: Sequence[str] = META) -> str | None:
    """The column that holds a statement's values: the first that names a range of dates, else the first that is no metadata; None if all are."""
    own = [c for c in columns if c not in meta]
    ranges = [c for c in own if len([x for x in c.replace("_", " ").replace("/", " ").split() if _is_date(x)]) >= 2]
    return next(iter(ranges or own), None)


def _is_date(text: str) -> bool:
    try:
        return bool(date.fromisoformat(text))
    except ValueError:
        return False


def current_period(statement: DataFrame, report_date: Column, meta: Sequence[str] = META) -> DataFrame | None:
    """A reported statement as long facts of its own period: (metadata, report_date, value); None without a column of values."""
    column = value_column(statement.columns, meta)
    if column is None:
        return None
    kept = [c for c in meta if c in statement.columns]
    return statement.select(*kept, report_date.alias("report_date"), F.col(f"`{column}`").cast("double").alias("value"))


def unpivot_statement(wide: DataFrame, ids: Sequence[str], periods: Sequence[str]) -> DataFrame:
    """A table with one column a period to long facts; rows without a value stay out."""
    return wide.unpivot(list(ids), list(periods), "report_date", "value").where("value IS NOT NULL")


def render(rows: Sequence, columns: Sequence[str], show: dict | None = None) -> str:
    """A markdown table of a collected, pivoted view: labels indented by level, a header line for each axis."""
    # Titles of well-known axes.
    titles = {"us-gaap:StatementBusinessSegmentsAxis": "Business Segments", "srt:ProductOrServiceAxis": "Products and Services", "us-gaap:StatementGeographicalAxis": "Geographic Breakdown", "us-gaap:StatementEquityComponentsAxis": "Equity Components", "srt:ConsolidationItemsAxis": "Consolidation Items"} | (show or {})
    out, axis = ["| | " + " | ".join(columns) + " |", "|---" * (len(columns) + 1) + "|"], ""
    for row in rows:
        r = row.asDict()
        if r.get("axis") and r["axis"] != axis:
            out.append(f"| **{titles.get(r['axis'], r['axis'].split(':')[-1])}** |" + " |" * len(columns))
        axis = r.get("axis") or ""
        out.append("| " + "&nbsp;&nbsp;" * int(r.get("level") or 0) + str(r.get("label") or r["concept"]) + " | " + " | ".join(_money(r.get(c)) for c in columns) + " |")
    return "\n".join(out)


def _money(v) -> str:
    if v is None or v != v or v == 0:
        return "-"
    for size, mark in ((1e9, "B"), (1e6, "M"), (1e3, "K")):
        if abs(v) >= size:
            return f"${v / size:.3f}{mark}"
    return f"${v:.3f}"
