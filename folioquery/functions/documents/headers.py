"""Context headers for chunks: company, sector, filing, and what the chunk is part of."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _full(c: Column) -> Column:
    """Null for empty text."""
    return F.nullif(c.cast("string"), F.lit(""))


def company_line(name: Column, symbols: Column, exchanges: Column) -> Column:
    """``# Name (SYM - EXCH)``; null without a name."""
    symbol, exchange = _full(F.get(symbols, F.lit(0))), _full(F.get(exchanges, F.lit(0)))
    mark = F.concat(F.lit(" ("), F.concat_ws(" - ", symbol, F.when(symbol.isNotNull(), exchange)), F.lit(")"))
    return F.concat(F.lit("# "), _full(name), F.when(symbol.isNotNull(), mark).otherwise(F.lit("")))


def sector_line(sector: Column, industry: Column) -> Column:
    line = F.concat_ws(" | ", F.concat(F.lit("Sector: "), _full(sector)), F.concat(F.lit("Industry: "), _full(industry)))
    return F.nullif(line, F.lit(""))


def filing_line(form: Column, year: Column, period: Column, filed: Column, report: Column) -> Column:
    fiscal = F.concat(F.lit("FY "), year.cast("string"), F.when(_full(period).isNotNull() & (period != "FY"), F.concat(F.lit(" "), period)).otherwise(F.lit("")))
    line = F.concat_ws(" | ", F.concat(F.lit("Form "), _full(form)), fiscal, F.concat(F.lit("Filed: "), _full(filed)), F.concat(F.lit("Period Ending: "), _full(report)))
    return F.nullif(line, F.lit(""))


def _title(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def section_line(section: Column) -> Column:
    return F.concat(F.lit("\n## "), _title(_full(section)), F.lit("\n"))


def note_line(title: Column) -> Column:
    return F.concat(F.lit("\n## "), _full(title), F.lit("\n"))


def attachment_line(kind: Column, exhibit: Column, description: Column) -> Column:
    known = _full(kind).isNotNull() & _full(exhibit).isNotNull()
    parts = F.concat_ws(" - ", F.concat(F.lit("Exhibit "), exhibit), _title(kind), _full(description))
    return F.when(known, F.concat(F.lit("\n## "), parts, F.lit("\n")))


def header(*lines: Column) -> Column:
    """The lines that are there, one below the other."""
    return F.concat_ws("\n", *lines)


def truncated(text: Column, most: int) -> Column:
    """The bound on text for a summary: 5000 characters of an attachment, 1500 of a note."""
    return F.substring(text, 1, most)
