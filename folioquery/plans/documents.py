"""Document processing on pages, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.documents import chunker, flat_map, headers, html, positioned, sections, tables, transcripts
from .fixtures import loader, spread, spread_by_rows
from .registry import query


@query()
def html_pages(spark, d):
    """Every page as markdown, one row a page of its document; markup that cannot be read gives one row with the ``error``."""
    rows = spread(loader(spark, d)("pages").select("page_id", "html"))
    return flat_map(rows, lambda r: [{"page_id": r["page_id"], **p} for p in html.to_pages(r["html"])], "page_id long, page int, content string, error string", keys=("page_id",))


@query("SELECT page_id, (page_id * 37 % 5000) + 1 AS depth, 'deep ' || page_id AS content FROM pages")
def html_deep(spark, d):
    """Unclosed elements up to 5,000 deep."""
    n = (F.col("page_id") * 37 % 5000).cast("int") + 1
    tag = F.when(F.col("page_id") % 3 == 0, "<div>").when(F.col("page_id") % 3 == 1, "<span>").otherwise("<ul><li>")
    made = F.concat(F.repeat(tag, n), F.lit("deep "), F.col("page_id").cast("string"))
    rows = spread(loader(spark, d)("pages").select("page_id")).select("page_id", n.cast("long").alias("depth"), made.alias("html"))
    work = lambda r: [{"page_id": r["page_id"], "depth": r["depth"], "content": p["content"].replace("- ", "")} for p in html.to_pages(r["html"])]
    return flat_map(rows, work, "page_id long, depth long, content string")


@query()
def html_retention(spark, d):
    """How much of each document's visible text comes out."""
    rows = spread(loader(spark, d)("pages").select("page_id", "html"))
    return flat_map(rows, lambda r: [{"page_id": r["page_id"], "retention": html.retention(r["html"], html.to_pages(r["html"]))}], "page_id long, retention double")


_ROW = "'<tr><td>' || l_linenumber || '</td><td>$</td><td>' || printf('%.2f', l_extendedprice) || '</td><td>' || printf('%.0f', l_discount * 100) || '</td><td>%</td></tr>'"


@query(f"""
SELECT l_orderkey, '| line | price | discount |' || chr(10) || '|---|---|---|' || chr(10) ||
  string_agg('| ' || l_linenumber || ' | $ ' || printf('%.2f', l_extendedprice) || ' | ' || printf('%.0f', l_discount * 100) || ' % |', chr(10) ORDER BY l_linenumber, {_ROW}) AS markdown
FROM lineitem GROUP BY l_orderkey
""")
def html_tables(spark, d):
    """Order lines laid out as HTML tables with split cells, rebuilt as markdown."""
    line = F.concat(F.lit("<tr><td>"), F.col("l_linenumber").cast("string"), F.lit("</td><td>$</td><td>"), F.format_string("%.2f", F.col("l_extendedprice")), F.lit("</td><td>"), F.format_string("%.0f", F.col("l_discount") * 100), F.lit("</td><td>%</td></tr>"))
    rows = loader(spark, d)("lineitem").select("l_orderkey", F.struct("l_linenumber", line.alias("html")).alias("r"))
    made = rows.groupBy("l_orderkey").agg(F.concat(F.lit("<table><tr><th>line</th><th colspan=2>price</th><th colspan=2>discount</th></tr>"), F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["html"]), ""), F.lit("</table>")).alias("html"))
    return flat_map(made, lambda r: [{"l_orderkey": r["l_orderkey"], "markdown": html.to_pages(r["html"])[0]["content"]}], "l_orderkey long, markdown string")


@query("SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS n, CASE WHEN starts_with(line, '#') THEN 'header' WHEN contains(line, '|') THEN 'table' ELSE 'text' END AS kind FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS n FROM documents)")
def chunk_lines(spark, d):
    """Every line and its kind; natively, without a shuffle."""
    lines = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "line")
    rows = loader(spark, d)("documents").select("doc_id", lines)
    kind = F.when(F.col("line").startswith("#"), "header").when(F.contains(F.col("line"), F.lit("|")), "table").otherwise("text")
    return rows.select("doc_id", (F.col("n") + 1).cast("long").alias("n"), kind.alias("kind"))


_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160)"
_CELLS = f"list_transform(string_split(regexp_replace(trim(line, {_WS}), '^[|]+|[|]+$', '', 'g'), '|'), lambda c: trim(regexp_replace(c, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}]+', ' ', 'g'), {_WS}))"
#: A table's row from its cells; the second line is the separator if all its cells are.
_LINE = "'|' || array_to_string(CASE WHEN n = 2 AND len(list_filter(cells, lambda c: NOT regexp_full_match(c, ':?-+:?'))) = 0 THEN list_transform(cells, lambda c: '---') ELSE cells END, '|') || '|'"
_LINES = "SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents"


@query(f"""
WITH l AS ({_LINES}), k AS (SELECT *, contains(line, '|') AS bar, i - row_number() OVER (PARTITION BY doc_id, contains(line, '|') ORDER BY i) AS run FROM l),
t AS (SELECT doc_id, i, run, row_number() OVER (PARTITION BY doc_id, run ORDER BY i) AS n, {_CELLS} AS cells FROM k WHERE bar),
b AS (SELECT doc_id, min(i) AS i, 'table' AS kind, string_agg({_LINE}, chr(10) ORDER BY i) AS text FROM t GROUP BY doc_id, run
      UNION ALL SELECT doc_id, i, CASE WHEN starts_with(line, '#') THEN 'header' ELSE 'text' END, line FROM k WHERE NOT bar)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS n, kind, text FROM b
""")
def chunk_blocks(spark, d):
    rows = loader(spark, d)("documents").select("doc_id", "text")
    work = lambda r: [{"doc_id": r["doc_id"], "n": i, "kind": b.kind, "text": b.text} for i, b in enumerate(chunker.blocks_of([{"page": 1, "content": r["text"]}]))]
    return flat_map(rows, work, "doc_id long, n int, kind string, text string")


@query("SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[.!?][\\t\\n\\f\\r ]+[A-Z]')) + 1 AS BIGINT) AS n FROM documents")
def chunk_sentences(spark, d):
    pieces = F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?])[\t\n\f\r ]+(?=[A-Z])")
    return loader(spark, d)("documents").select("doc_id", F.size(pieces).cast("long").alias("n"))


@query()
def chunk_pack(spark, d):
    """Documents in chunks of at most 1024 tokens, as in production."""
    rows = spread(loader(spark, d)("documents"))
    pages = F.array(F.struct(F.lit(1).alias("page"), F.coalesce("text", F.lit("")).alias("content")))
    head = headers.header(headers.company_line(F.col("source"), F.array(F.col("lang")), F.array(F.lit("X"))))
    return chunker.chunk_pages(rows.select(F.col("doc_id").alias("id"), pages.alias("pages"), head.alias("header")))


@query("SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) AS BIGINT) AS tokens FROM documents")
def token_count(spark, d):
    return loader(spark, d)("documents").select("doc_id", tx.count_tokens(F.coalesce("text", F.lit(""))).cast("long").alias("tokens"))


@query(f"""
WITH l AS (SELECT doc_id, unnest(string_split(trim(text, {_WS}), chr(10))) AS line, unnest(range(1, 1 + len(string_split(trim(text, {_WS}), chr(10))))) AS n FROM documents WHERE contains(text, '|'))
SELECT doc_id, string_agg({_LINE}, chr(10) ORDER BY n) AS text FROM (SELECT doc_id, n, {_CELLS} AS cells FROM l) GROUP BY doc_id
""")
def table_minify(spark, d):
    """Whole documents that hold a bar, as if each were a table."""
    rows = loader(spark, d)("documents").where(F.contains(F.col("text"), F.lit("|"))).select("doc_id", "text")
    return flat_map(rows, lambda r: [{"doc_id": r["doc_id"], "text": tables.minify(r["text"])}], "doc_id long, text string")


_EXHIBIT = "(l_linenumber * 7 + l_partkey) % 30 || '.' || l_linenumber"


@query(f"""
SELECT l_orderkey, l_linenumber, exhibit, CASE split_part(exhibit, '.', 1) WHEN '1' THEN 'underwriting_agreement' WHEN '5' THEN 'legal_opinion' WHEN '10' THEN 'material_contract' WHEN '21' THEN 'subsidiaries' WHEN '23' THEN 'consent' WHEN '99' THEN 'press_or_investor'
  WHEN '2' THEN CASE split_part(exhibit, '.', 2) WHEN '1' THEN 'merger_agreement' ELSE 'other' END
  WHEN '3' THEN CASE split_part(exhibit, '.', 2) WHEN '1' THEN 'certificate_of_designations' WHEN '2' THEN 'bylaws' ELSE 'charter' END
  WHEN '4' THEN CASE split_part(exhibit, '.', 2) WHEN '1' THEN 'indenture' WHEN '2' THEN 'supplemental_indenture' ELSE 'debt_instrument' END ELSE 'other' END AS kind
FROM (SELECT l_orderkey, l_linenumber, {_EXHIBIT} AS exhibit FROM lineitem)
""")
def attachment_type(spark, d):
    n = F.col("l_linenumber")
    exhibit = F.concat(((n * 7 + F.col("l_partkey")) % 30).cast("string"), F.lit("."), n.cast("string"))
    rows = loader(spark, d)("lineitem").select("l_orderkey", "l_linenumber", exhibit.alias("exhibit"))
    return rows.withColumn("kind", sections.attachment_type(F.col("exhibit")))


@query("""
WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, printf('%.2f', o_totalprice) AS p FROM orders)
SELECT k AS filing_id, 'PART I' AS part, 'ITEM 1' AS item, 'Business' AS title, 'business' AS section, 1 AS page, 'ITEM 1. Business' || chr(10) || 'We fill order ' || k AS content FROM o
UNION ALL SELECT k, 'PART I', 'ITEM 1', 'Business', 'business', 2, 'and more of it.' FROM o
UNION ALL SELECT k, 'PART I', 'ITEM 1A', 'Risk Factors', 'risk_factors', 2, 'ITEM 1A. Risk Factors' || chr(10) || 'Status ' || s FROM o
UNION ALL SELECT k, 'PART II', 'ITEM 7', 'Analysis', 'md&a', 3, 'ITEM 7. Analysis' || chr(10) || 'Total ' || p FROM o
""")
def sections_extract(spark, d):
    """Orders as 10-K filings: three pages of items made from each order, sections cut from them, one row a page."""
    o = spread_by_rows(loader(spark, d)("orders").select("o_orderkey", "o_orderstatus", "o_totalprice"))
    k = F.col("o_orderkey").cast("string")
    page = lambda n, *parts: F.struct(F.lit(n).alias("page"), F.concat(*parts).alias("content"))
    pages = F.array(page(1, F.lit("PART I\nITEM 1. Business\nWe fill order "), k), page(2, F.lit("and more of it.\nITEM 1A. Risk Factors\nStatus "), F.col("o_orderstatus")), page(3, F.lit("PART II\nITEM 7. Analysis\n17\nTotal "), F.format_string("%.2f", F.col("o_totalprice"))))
    found = sections.extract_sections(o.select(F.col("o_orderkey").alias("filing_id"), F.lit("10-K").alias("form"), pages.alias("pages")))
    return found.select("filing_id", "part", "item", "title", "section", F.explode("pages").alias("p")).select("filing_id", "part", "item", "title", "section", "p.page", "p.content")


def _transcripts(spark, d):
    """Conversations as transcripts: roles are speakers, each conversation's first turn is the Operator's."""
    rows = loader(spark, d)("conversations")
    speaker = F.when(F.col("turn") == 0, "Operator").otherwise(F.initcap("role"))
    line = F.concat(speaker, F.lit(": "), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")))
    made = rows.groupBy(F.col("conv_id").alias("transcript_id")).agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    return made.select("transcript_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


@query(f"""
WITH l AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'Operator' ELSE upper(role[1]) || lower(role[2:]) END AS speaker, replace(coalesce(text, ''), chr(10), ' ') AS t FROM conversations WHERE turn = 0 OR role IS NOT NULL),
k AS (SELECT conv_id, turn, speaker, trim(t, {_WS}) AS content FROM l)
SELECT conv_id AS transcript_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, speaker || ': ' || content) AS INTEGER) AS n, speaker, content FROM k WHERE content <> ''
""")
def transcript_parse(spark, d):
    """One row a turn with words."""
    found = transcripts.parse_transcripts(_transcripts(spark, d))
    return found.select("transcript_id", F.posexplode("sections").alias("n", "s")).select("transcript_id", (F.col("n") + 1).alias("n"), "s.speaker", "s.content")


@query()
def transcript_split(spark, d):
    return transcripts.chunk_transcripts(transcripts.parse_transcripts(_transcripts(spark, d)), 256, 64)


@query("""
SELECT c_custkey, '# ' || c_name || ' (C' || c_custkey || ' - NYSE)' || chr(10) || 'Sector: ' || c_mktsegment || chr(10) || 'Form 10-K | FY 2024 | Filed: 2024-02-01 | Period Ending: 2023-12-31' AS header FROM customer
""")
def chunk_headers(spark, d):
    c = loader(spark, d)("customer")
    none = F.lit(None).cast("string")
    head = headers.header(
        headers.company_line(F.col("c_name"), F.array(F.concat(F.lit("C"), F.col("c_custkey").cast("string"))), F.array(F.lit("NYSE"))),
        headers.sector_line(F.col("c_mktsegment"), none),
        headers.filing_line(F.lit("10-K"), F.lit(2024), F.lit("FY"), F.lit("2024-02-01"), F.lit("2023-12-31")),
    )
    return c.select("c_custkey", head.alias("header"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%m%d') AS mmdd, strftime(o_orderdate, '%B ') || day(o_orderdate) AS shown FROM orders")
def fiscal_year_end(spark, d):
    mmdd = F.date_format("o_orderdate", "MMdd")
    return loader(spark, d)("orders").select("o_orderkey", mmdd.alias("mmdd"), tx.format_year_end(mmdd).alias("shown"))


_BOXES = """SELECT l_orderkey AS page, l_partkey * 10 + l_linenumber AS box, CAST((l_suppkey * 3 + l_linenumber) % 3 * 100 AS DOUBLE) AS x,
  CAST((l_linenumber + l_partkey % 2) * 20 + l_partkey % 6 + CASE WHEN l_partkey % 5 = 0 THEN 40 ELSE 0 END AS DOUBLE) AS y FROM lineitem"""


@query(f"""
WITH b AS ({_BOXES}),
g AS (SELECT *, y - lag(y) OVER (PARTITION BY page ORDER BY y, x) AS gap FROM b),
m AS (SELECT page, median(gap) FILTER (WHERE gap > 5 AND gap < 100) AS usual FROM g GROUP BY page),
r AS (SELECT page, box, y, x, CAST(floor(y / 20) AS BIGINT) AS line,
        sum(CASE WHEN gap > coalesce(least(1.2 * usual, 30.0), 30.0) THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y, x ROWS UNBOUNDED PRECEDING) AS run
      FROM g JOIN m USING (page)),
n AS (SELECT *, count(*) OVER (PARTITION BY page, run, line) AS many FROM r),
l AS (SELECT *, max(CASE WHEN many > 1 THEN line END) OVER (PARTITION BY page, run) AS several FROM n),
after AS (SELECT page, run, count(DISTINCT line) AS singles FROM l WHERE line > several GROUP BY page, run),
k AS (SELECT l.*, CASE WHEN line > several AND singles >= 2 THEN 1 ELSE 0 END AS cut FROM l LEFT JOIN after USING (page, run))
SELECT page, box, dense_rank() OVER (PARTITION BY page ORDER BY run, cut)::INTEGER - 1 AS grp FROM k
""")
def gap_groups(spark, d):
    """Boxes made from order lines, split where a gap is wide or several columns become one."""
    l = loader(spark, d)("lineitem")  # noqa: E741
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    top = (n + p % 2) * 20 + p % 6 + F.when(p % 5 == 0, 40).otherwise(0)
    boxes = l.select(F.col("l_orderkey").alias("page"), (p * 10 + n).alias("box"), ((F.col("l_suppkey") * 3 + n) % 3 * 100).cast("double").alias("left"), top.cast("double").alias("top"))
    return positioned.gap_groups(boxes, ["page"]).select("page", "box", "grp")
