"""Ingest flows by form: from filings with HTML to pages, sections, chunks, notes and attachments.

Every flow is a DAG of DataFrames over all filings of a batch; nothing loops over filings on the driver. ``filings`` has
filing_id, company_id, form, items, html, fiscal_year, fiscal_period, filing_date, report_date; ``companies`` has id, name,
symbols, exchanges, sector, industry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.documents import chunker, flat_map, headers, html, sections

PAGES = "array<struct<page:int,content:string>>"
# Production chunk size and overlap.
SIZE, OVERLAP = 1024, 0
BASE = ("10-K", "10-Q", "20-F")


def _parsed(rows: DataFrame, key: str) -> DataFrame:
    """(key, pages, error) of every row's HTML; one that cannot be parsed has an error instead of pages."""
    return flat_map(rows.select(key, "html"), lambda r: [{key: r[key], "pages": html.to_pages(r["html"])}], f"{key} long, pages {PAGES}, error string", keys=[key])


def with_pages(filings: DataFrame) -> DataFrame:
    """(filing_id, pages, error) of every filing's HTML."""
    return _parsed(filings, "filing_id")


def page_rows(paged: DataFrame, filings: DataFrame, key: str = "filing_id") -> DataFrame:
    """One row a page."""
    rows = paged.select(key, F.explode("pages").alias("p")).select(key, "p.page", "p.content")
    return rows.join(filings.select(key, "company_id"), key)


def base_form(form: Column) -> Column:
    return F.regexp_replace(form, "/A$", "")


def header_of(rows: DataFrame, *last: Column) -> Column:
    """The context header of rows that carry their company's and filing's columns."""
    c = rows.columns
    at = lambda n, kind="string": F.col(n) if n in c else F.lit(None).cast(kind)
    return headers.header(
        headers.company_line(at("name"), at("symbols", "array<string>"), at("exchanges", "array<string>")),
        headers.sector_line(at("sector"), at("industry")),
        headers.filing_line(at("form"), at("fiscal_year", "int"), at("fiscal_period"), at("filing_date").cast("string"), at("report_date").cast("string")),
        *last,
    )


def _known(filings: DataFrame, companies: DataFrame) -> DataFrame:
    own = filings.select(*[c for c in ("filing_id", "company_id", "form", "fiscal_year", "fiscal_period", "filing_date", "report_date") if c in filings.columns])
    return own.join(companies.select(F.col("id").alias("company_id"), "name", "symbols", "exchanges", "sector", "industry"), "company_id", "left")


def _chunks(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Chunk rows (keep..., pages, header); ``keep`` columns identify what is chunked."""
    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def work(row: dict) -> Iterator[dict]:
        for i, c in enumerate(chunker.split(row["pages"] or [], row["header"] or "", SIZE, OVERLAP)):
            yield {**{k: row[k] for k in keep}, "index": i, "page": c["page"], "pages": c["pages"], "embedding": c["embedding_text"], "has_table": c["has_table"]}

    return flat_map(rows.select(*keep, "pages", "header"), work, f"{kept}, index int, page int, pages {PAGES}, embedding string, has_table boolean, error string", keys=keep)


def periodic(filings: DataFrame, paged: DataFrame, companies: DataFrame) -> dict[str, DataFrame]:
    """10-K, 10-Q and 20-F: named sections, their pages and chunks."""
    rows = filings.where(base_form(F.col("form")).isin(*BASE)).select("filing_id", "form").join(paged, "filing_id")
    found = sections.extract_sections(rows).where("section IS NOT NULL").select("filing_id", "section", "pages")
    # several items may carry one section's name: their pages join, in order
    merged = found.groupBy("filing_id", "section").agg(F.array_sort(F.flatten(F.collect_list("pages"))).alias("pages"))
    out = merged.select("filing_id", "section", F.explode("pages").alias("p")).groupBy("filing_id", "section", "p.page").agg(F.array_join(F.array_sort(F.collect_list("p.content")), "\n\n").alias("content"))
    known = _known(filings, companies)
    wide = merged.join(known, "filing_id")
    wide = wide.withColumn("header", header_of(wide, headers.section_line(F.col("section"))))
    page = out.withColumn("has_table", F.contains("content", F.lit("|"))).join(filings.select("filing_id", "company_id"), "filing_id")
    return {"filing_section_pages": page, "filing_section_chunks": _chunks(wide, ["filing_id", "company_id", "section"])}


def whole(filings: DataFrame, paged: DataFrame, companies: DataFrame, section: str, skip: int = 0) -> DataFrame:
    """Chunks of all pages after the first ``skip``, as one section: current reports and proxy statements."""
    rows = _known(filings, companies).join(paged, "filing_id").withColumn("section", F.lit(section))
    rows = rows.withColumn("pages", F.filter("pages", lambda p: p["page"] > skip))
    return _chunks(rows.withColumn("header", header_of(rows, headers.section_line(F.col("section")))), ["filing_id", "company_id", "section"])


def attachments(files: DataFrame, filings: DataFrame, companies: DataFrame) -> dict[str, DataFrame]:
    """From (attachment_id, filing_id, exhibit_number, filename, description, html): typed attachments, pages, and chunks of the kinds that are searched."""
    typed = files.withColumn("type", sections.attachment_type(F.col("exhibit_number")))
    met = typed.drop("html").join(_parsed(files, "attachment_id"), "attachment_id").join(_known(filings, companies), "filing_id")
    rows = met.where(F.col("type").isin(*sections.CHUNKABLE))
    rows = rows.withColumn("header", header_of(rows, headers.attachment_line(F.col("type"), F.col("exhibit_number"), F.col("description"))))
    return {
        "filing_attachments": met.select(F.col("attachment_id").alias("id"), "filing_id", "company_id", "exhibit_number", "filename", "description", "type", F.size("pages").alias("num_pages"), "error"),
        "filing_attachment_pages": met.select("attachment_id", "filing_id", "company_id", F.explode("pages").alias("p")).select("attachment_id", "filing_id", "company_id", "p.page", "p.content"),
        "filing_attachment_chunks": _chunks(rows, ["attachment_id", "filing_id", "company_id"]),
    }


def notes(files: DataFrame, filings: DataFrame, companies: DataFrame) -> dict[str, DataFrame]:
    """From (note_id, filing_id, title, filename, html): flattened notes and their chunks."""
    flat = flat_map(files.select("note_id", "html"), lambda r: [{"note_id": r["note_id"], "content": html.flatten_note(r["html"])}], "note_id long, content string, error string", keys=["note_id"])
    met = files.drop("html").join(flat, "note_id").join(_known(filings, companies), "filing_id")
    rows = met.withColumn("pages", F.array(F.struct(F.lit(1).alias("page"), "content")))
    rows = rows.withColumn("header", header_of(rows, headers.note_line(F.col("title"))))
    return {
        "filing_notes": met.select(F.col("note_id").alias("id"), "filing_id", "company_id", "title", "filename", "content", headers.truncated(F.col("content"), 1500).alias("preview"), "error"),
        "filing_note_chunks": _chunks(rows, ["note_id", "filing_id", "company_id"]),
    }


def process(filings: DataFrame, companies: DataFrame, stage: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> dict[str, DataFrame]:
    """All tables of a batch of filings, in the order in which they are to be written. A current report is a press release if item 9.01 is among its
    items; its cover page is not chunked. ``filings`` comes last, with counts and the synced flag; what failed is in ``filing_errors``
    (filing_id, step, error), and its filing is not synced.

    ``stage`` may write a frame that several tables are made from and read it back, so that HTML is parsed and chunks are cut once.
    """
    readable = filings.where("error IS NULL") if "error" in filings.columns else filings
    parsed = stage(with_pages(readable), "pages")
    paged = parsed.where("error IS NULL").drop("error")
    of = lambda *forms: filings.where(base_form(F.col("form")).isin(*forms))
    out = periodic(filings, paged, companies)
    reports = whole(of("8-K", "6-K"), paged, companies, "current_report", skip=1)
    proxies = whole(of("DEF 14A"), paged, companies, "proxy_statement")
    chunks = stage(out["filing_section_chunks"].unionByName(reports).unionByName(proxies), "chunks")
    failed = parsed.where("error IS NOT NULL").select("filing_id", F.lit("pages").alias("step"), "error")
    failed = failed.unionByName(chunks.where("error IS NOT NULL").select("filing_id", F.concat(F.lit("chunks of "), "section").alias("step"), "error"))
    if "error" in filings.columns:  # what the source could not read
        failed = failed.unionByName(filings.where("error IS NOT NULL").select("filing_id", F.lit("source").alias("step"), "error"))
    press = F.coalesce(F.array_contains("items", "9.01"), F.lit(False)) & (base_form(F.col("form")) == "8-K")
    own = [c for c in filings.columns if c not in ("html", "error")]
    counted = filings.select(*own).join(paged.select("filing_id", F.size("pages").alias("num_pages")), "filing_id", "left")
    sound = counted.join(failed.select("filing_id").distinct().withColumn("__failed", F.lit(True)), "filing_id", "left")
    return {
        "filing_pages": page_rows(paged, filings),
        "filing_section_pages": out["filing_section_pages"],
        "filing_section_chunks": chunks.where("error IS NULL").drop("error"),
        "filing_errors": failed,
        "filings": sound.withColumn("press_release", press).withColumn("synced", F.col("__failed").isNull()).drop("__failed"),
    }
