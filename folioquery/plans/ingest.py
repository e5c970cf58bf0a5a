"""Files as sources and what an ingest writes: markup of filings, flows by form, sync states, vector files; made from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.documents import flat_map, headers, html, sections, transcripts
from ..operators import statements as st
from ..operators import writes as wr
from ..operators.schema import define
from ..operators.vector import VectorStore
from ..sources import companies, evals
from ..sources import filings as source
from ..storage import shared_dir
from ..streaming import flows
from ..streaming import ingest as sync
from .canned import forms_of
from .finance import facts
from .fixtures import loader, spread
from .registry import query


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _markdown(rows: DataFrame, key: str) -> DataFrame:
    """(key, content): the first page of each row's ``html``."""
    return flat_map(rows.select(key, "html"), lambda r: [{key: r[key], "content": html.to_pages(r["html"])[0]["content"]}], f"`{key}` long, content string")


def _by_order(spark, d, *parts, join: str = "") -> DataFrame:
    """(l_orderkey, lines): a piece of markup for each line of an order, in order."""
    rows = loader(spark, d)("lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", F.concat(*parts).alias("x")).alias("r"))
    return rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["x"]), join).alias("lines"))


_AT = "l_linenumber, l_partkey"


def _shown() -> tuple:
    """Number, part and quantity of an order line as text."""
    return F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.format_string("%.0f", F.col("l_quantity"))


@query(f"SELECT l_orderkey, string_agg('Line **' || l_linenumber || '** of *part ' || l_partkey || '* & more', chr(10) || chr(10) ORDER BY {_AT}) AS content FROM lineitem GROUP BY l_orderkey")
def html_inline(spark, d):
    """Emphasis, references and white space inside paragraphs."""
    n, p, _ = _shown()
    rows = _by_order(spark, d, F.lit("<p>Line&nbsp;<b>"), n, F.lit("</b>\n of  <i>part "), p, F.lit("</i> &amp;  more</p>"))
    return _markdown(rows.withColumn("html", F.col("lines")), "l_orderkey")


@query(f"SELECT l_orderkey, 'Parts' || chr(10) || chr(10) || string_agg(n || '. part ' || l_partkey, chr(10) ORDER BY n) || chr(10) || chr(10) || string_agg('- ' || q, chr(10) ORDER BY n) AS content FROM (SELECT l_orderkey, l_partkey, printf('%.0f', l_quantity) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_AT}, printf('%.0f', l_quantity)) AS n FROM lineitem) GROUP BY l_orderkey")
def html_lists(spark, d):
    """A numbered list and a plain one, items unclosed."""
    _, p, q = _shown()
    first = _by_order(spark, d, F.lit("<li>part "), p)
    second = _by_order(spark, d, F.lit("<li>• "), q).withColumnRenamed("lines", "more")
    both = first.join(second, "l_orderkey")
    return _markdown(both.withColumn("html", F.concat(F.lit("<p>Parts</p><ol>"), "lines", F.lit("</ol><ul>"), "more", F.lit("</ul>"))), "l_orderkey")


@query("SELECT o_orderkey, 'ITEM 1A. Risk of ' || o_orderkey || chr(10) || chr(10) || 'PART II' || chr(10) || chr(10) || '- bullet ' || o_orderstatus AS content FROM orders")
def html_banners(spark, d):
    """Tables of one row are headings or bullets, not tables."""
    o = loader(spark, d)("orders")
    page = F.concat(F.lit("<table><tr><td>Item 1A.</td><td>Risk of "), F.col("o_orderkey").cast("string"), F.lit("</td></tr></table><table><tr><td>Part ii</td></tr></table><table><tr><td>•</td><td>bullet "), "o_orderstatus", F.lit("</td></tr></table>"))
    return _markdown(spread(o.select("o_orderkey", page.alias("html"))), "o_orderkey")


@query(f"SELECT l_orderkey, string_agg('Note ' || l_linenumber || ' on ' || l_partkey, chr(10) || chr(10) ORDER BY {_AT}) AS content FROM lineitem GROUP BY l_orderkey")
def note_flatten(spark, d):
    """Notes are laid out as an outer table, whose cells are their paragraphs."""
    n, p, _ = _shown()
    rows = _by_order(spark, d, F.lit("<tr><td><p>Note "), n, F.lit(" on "), p, F.lit("</p></td></tr>"))
    made = rows.select("l_orderkey", F.concat(F.lit("<table><tbody>"), "lines", F.lit("</tbody></table>")).alias("html"))
    return flat_map(made, lambda r: [{"l_orderkey": r["l_orderkey"], "content": html.flatten_note(r["html"])}], "l_orderkey long, content string")


_CELL = "CAST(l_linenumber AS VARCHAR)"


@query(f"""
SELECT l_orderkey, '|  | Year — price | part |' || chr(10) || '|---|---|---|' || chr(10) ||
  string_agg('| a' || l_linenumber || ' | $ ' || printf('%.2f', l_extendedprice) || ' | ' || l_partkey || ' |', chr(10) ORDER BY {_AT}, printf('%.2f', l_extendedprice)) AS content
FROM lineitem GROUP BY l_orderkey
""")
def html_two_headers(spark, d):
    """Two header rows become one, where the upper one's span begins, and a currency sign joins its figure."""
    n, p, _ = _shown()
    price = F.format_string("%.2f", F.col("l_extendedprice"))
    rows = _by_order(spark, d, F.lit("<tr><td>a"), n, F.lit("</td><td>$</td><td>"), price, F.lit("</td><td>"), p, F.lit("</td></tr>"))
    head = "<table><tr><td></td><td colspan=3>Year</td></tr><tr><td></td><td colspan=2>price</td><td>part</td></tr>"
    return _markdown(rows.select("l_orderkey", F.concat(F.lit(head), "lines", F.lit("</table>")).alias("html")), "l_orderkey")


_BOX = "SELECT l_orderkey, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS n, count(*) OVER (PARTITION BY l_orderkey) AS many FROM lineitem"


def _boxes(spark, d) -> DataFrame:
    """Orders of at least two lines, numbered anew."""
    rows = loader(spark, d)("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("r"))
    return rows.where(F.size("r") > 1)


def _box(left: int, n, *text) -> F.Column:
    return F.concat(F.lit(f'<div style="position:absolute;left:{left}px;top:'), (n * 20).cast("string"), F.lit('px">'), *text, F.lit("</div>"))


@query(f"""
WITH r AS ({_BOX})
SELECT l_orderkey, string_agg('| ' || n || ' | ' || (l_partkey + 1000) || ' | ' || printf('%.0f', l_quantity) || ' % |' || CASE WHEN n = 1 THEN chr(10) || '|---|---|---|' ELSE '' END, chr(10) ORDER BY n) AS content
FROM r WHERE many > 1 GROUP BY l_orderkey
""")
def positioned_tables(spark, d):
    """Boxes that form a grid of figures are a table."""
    cells = lambda x, i: F.concat(_box(10, i + 1, (i + 1).cast("string")), _box(110, i + 1, (x["l_partkey"] + 1000).cast("string")), _box(210, i + 1, F.format_string("%.0f", x["l_quantity"]), F.lit(" %")))
    made = _boxes(spark, d).select("l_orderkey", F.concat(F.lit("<div>"), F.array_join(F.transform("r", cells), ""), F.lit("</div>")).alias("html"))
    return _markdown(made, "l_orderkey")


@query(f"WITH r AS ({_BOX}) SELECT l_orderkey, string_agg('Part ' || l_partkey || ' is sold by the ' || 'dozen.', chr(10) ORDER BY n) AS content FROM r WHERE many > 1 GROUP BY l_orderkey")
def positioned_text(spark, d):
    """Boxes below each other are lines of text; a hyphen at a line's end is undone."""
    lines = lambda x, i: F.concat(_box(10, i * 2 + 1, F.lit("Part "), x["l_partkey"].cast("string"), F.lit(" is sold by the do-")), _box(10, i * 2 + 2, F.lit("zen.")))
    made = _boxes(spark, d).select("l_orderkey", F.concat(F.lit("<div>"), F.array_join(F.transform("r", lines), ""), F.lit("</div>")).alias("html"))
    return _markdown(made, "l_orderkey")


def _ten_k(spark, d) -> DataFrame:
    """Customers' 10-K filings."""
    c = loader(spark, d)("customer")
    k = F.col("c_custkey").cast("string")
    page = F.concat(F.lit("<p>PART I</p><p>ITEM 1. Business</p><p>We serve "), "c_name", F.lit('.</p><p style="page-break-after:always"></p><p>ITEM 1A. Risk Factors</p><p>Segment '), "c_mktsegment", F.lit("</p><p>PART II</p><p>ITEM 7. Analysis</p><p>Key "), k, F.lit("</p>"))
    made = c.select(F.col("c_custkey").alias("filing_id"), F.col("c_nationkey").cast("long").alias("company_id"), F.when(F.col("c_custkey") % 5 == 0, "10-K/A").otherwise("10-K").alias("form"), F.lit(None).cast("array<string>").alias("items"), page.alias("html"), F.lit(2024).alias("fiscal_year"), F.lit("FY").alias("fiscal_period"), F.lit("2024-02-01").alias("filing_date"), F.lit("2023-12-31").alias("report_date"))
    return spread(made)


_HEAD = "'# ' || n_name || chr(10) || 'Form ' || CASE WHEN c_custkey % 5 = 0 THEN '10-K/A' ELSE '10-K' END || ' | FY 2024 | Filed: 2024-02-01 | Period Ending: 2023-12-31' || chr(10) || chr(10) || '## '"


@query(f"""
WITH c AS (SELECT c_custkey, c_name, c_mktsegment, {_HEAD} AS head FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey AS filing_id, 'business' AS section, 0 AS "index", 1 AS page, head || 'Business' || chr(10) || chr(10) || chr(10) || 'ITEM 1. Business' || chr(10) || chr(10) || 'We serve ' || c_name || '.' AS embedding FROM c
UNION ALL SELECT c_custkey, 'risk_factors', 0, 2, head || 'Risk Factors' || chr(10) || chr(10) || chr(10) || 'ITEM 1A. Risk Factors' || chr(10) || chr(10) || 'Segment ' || c_mktsegment FROM c
UNION ALL SELECT c_custkey, 'md&a', 0, 2, head || 'Md&a' || chr(10) || chr(10) || chr(10) || 'ITEM 7. Analysis' || chr(10) || chr(10) || 'Key ' || c_custkey FROM c
""")
def flow_annual_reports(spark, d):
    """Annual reports through pages and sections to chunks with their headers."""
    none = lambda t: F.lit(None).cast(t)
    known = loader(spark, d)("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), none("array<string>").alias("symbols"), none("array<string>").alias("exchanges"), none("string").alias("sector"), none("string").alias("industry"))
    return flows.process(_ten_k(spark, d), known)["filing_section_chunks"].select("filing_id", "section", "index", "page", "embedding")


@query("""
SELECT c_custkey AS filing_id, CASE WHEN c_custkey % 3 = 2 THEN 'proxy_statement' ELSE 'current_report' END AS section, CASE WHEN c_custkey % 3 = 2 THEN 1 ELSE 2 END AS page,
       CASE WHEN c_custkey % 3 = 2 THEN 2 ELSE 1 END::BIGINT AS chunk_pages, 2 AS num_pages, c_custkey % 3 = 0 AND c_custkey % 2 = 0 AS press_release, true AS synced
FROM customer
""")
def flow_other_reports(spark, d):
    """Current reports without their cover, proxy statements whole; 8-Ks with item 9.01 are press releases."""
    c = loader(spark, d)("customer")
    k = F.col("c_custkey")
    page = F.concat(F.lit('<p>cover</p><p style="page-break-after:always"></p><p>news of '), "c_name", F.lit("</p>"))
    form = F.when(k % 3 == 0, F.when(k % 5 == 0, "8-K/A").otherwise("8-K")).when(k % 3 == 1, "6-K").otherwise("DEF 14A")
    none = lambda t: F.lit(None).cast(t)
    filings = spread(c.select(k.alias("filing_id"), F.col("c_nationkey").cast("long").alias("company_id"), form.alias("form"), F.when(k % 2 == 0, F.array(F.lit("2.02"), F.lit("9.01"))).otherwise(F.array(F.lit("2.02"))).alias("items"), page.alias("html")))
    known = loader(spark, d)("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), none("array<string>").alias("symbols"), none("array<string>").alias("exchanges"), none("string").alias("sector"), none("string").alias("industry"))
    out = flows.process(filings, known)
    chunks = out["filing_section_chunks"].select("filing_id", "section", "page", F.size("pages").cast("long").alias("chunk_pages"))
    return chunks.join(out["filings"].select("filing_id", "num_pages", "press_release", "synced"), "filing_id")


@query("SELECT c_custkey AS filing_id, 'PART II' AS part, 'ITEM 7' AS item, 'Analysis' AS title FROM customer")
def section_lookup(spark, d):
    """One section of every filing, asked for in any case and spacing."""
    filings = _ten_k(spark, d)
    pages = filings.select("filing_id", "form").join(flows.with_pages(filings).where("error IS NULL"), "filing_id")
    return sections.section_of(sections.extract_sections(pages), "part  ii", "item 7").select("filing_id", "part", "item", "title")


@query("SELECT conv_id, 'Q' || (conv_id % 4 + 1) AS period, count(*) AS turns FROM conversations GROUP BY conv_id")
def transcript_period(spark, d):
    """A call stays with its quarter, the last one too."""
    c = loader(spark, d)("conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))
    return c.select("conv_id", transcripts.fiscal_period(F.col("conv_id") % 4 + 1).alias("period"), "turns")


@query("SELECT doc_id, left(text, 1500) AS note, length(left(text, 5000)) AS n FROM documents")
def summary_input(spark, d):
    """Texts as far as a summary reads them."""
    return loader(spark, d)("documents").select("doc_id", headers.truncated(F.col("text"), 1500).alias("note"), F.length(headers.truncated(F.col("text"), 5000)).cast("long").alias("n"))


@query("SELECT year(o_orderdate) AS fiscal_year, o_orderstatus AS concept, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS value FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2")
def stmt_segments(spark, d):
    """Facts of a segment stay out of a company's own statement."""
    f = facts(spark, d, quarters=(), annual=True).withColumn("dimension", F.col("concept") == "P")
    return st.without_segments(f).select("fiscal_year", "concept", "value")


@query("SELECT o_orderkey, form FROM (SELECT o_orderkey, ['10-K', '10-K/A', '10-Q', '8-K/A', '6-K', 'DEF 14A', '20-F'][o_orderkey % 7 + 1] AS form FROM orders) WHERE form IN ('10-K', '10-K/A', '20-F', '20-F/A', '8-K', '8-K/A', '6-K', '6-K/A')")
def form_filter(spark, d):
    """Filings of two kinds, amendments included."""
    form = F.get(F.array(*map(F.lit, ("10-K", "10-K/A", "10-Q", "8-K/A", "6-K", "DEF 14A", "20-F"))), (F.col("o_orderkey") % 7).cast("int"))
    rows = loader(spark, d)("orders").select("o_orderkey", form.alias("form"))
    return rows.where(F.col("form").isin(forms_of(["annual_reports", "current_reports"])))


_SPLIT = "regexp_extract_all(strip_accents(lower(coalesce({}, ''))), '[\\p{{L}}\\p{{N}}]+')"


@query(f"""
WITH k AS (SELECT doc_id, {_SPLIT.format("text")} AS a, {_SPLIT.format("source")} AS b FROM documents),
c AS (SELECT doc_id, len(a) + len(b) AS dl, 1.0 * len(list_filter(a, lambda t: starts_with(t, 'web'))) + 5.0 * len(list_filter(b, lambda t: starts_with(t, 'web'))) AS tf0,
             1.0 * len(list_filter(a, lambda t: t = 'idiot')) + 5.0 * len(list_filter(b, lambda t: t = 'idiot')) AS tf1 FROM k),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (WHERE tf0 > 0) AS df0, count(*) FILTER (WHERE tf1 > 0) AS df1 FROM c),
i AS (SELECT *, CASE WHEN ln((n - df0 + 0.5) / (df0 + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df0 + 0.5) / (df0 + 0.5)) END AS i0, CASE WHEN ln((n - df1 + 0.5) / (df1 + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df1 + 0.5) / (df1 + 0.5)) END AS i1 FROM c, s)
SELECT doc_id, round(i0 * tf0 * 2.2 / (tf0 + 1.2 * (0.25 + 0.75 * dl / avgdl)) + i1 * tf1 * 2.2 / (tf1 + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score FROM i WHERE tf0 > 0 OR tf1 > 0
""")
def text_weighted(spark, d):
    """Two columns ranked together: a word in the source counts five times one in the text."""
    docs = spread(loader(spark, d)("documents").select("doc_id", "text", "source"))
    ranks = tx.bm25(docs, "doc_id", {"text": 1.0, "source": 5.0}, [tx.Term(("web",), True), tx.Term(("idiot",))])
    return ranks.select("doc_id", F.round(-F.col("rank"), 6).alias("score"))


@query("""
SELECT o_custkey AS company_id, year(o_orderdate) AS fiscal_year,
       count(DISTINCT quarter(o_orderdate)) = count(DISTINCT quarter(o_orderdate)) FILTER (WHERE o_orderkey % 3 <> 0) AS complete
FROM orders GROUP BY 1, 2
""")
def quarters_complete(spark, d):
    """Whether every quarter that a source has is synced."""
    o = loader(spark, d)("orders").select("o_orderkey", F.col("o_custkey").alias("company_id"), F.year("o_orderdate").cast("long").alias("fiscal_year"), F.quarter("o_orderdate").alias("quarter"))
    have = o.where("o_orderkey % 3 <> 0").select("company_id", "fiscal_year", F.concat(F.lit("Q"), F.col("quarter").cast("string")).alias("fiscal_period"))
    return sync.quarters_complete(o, have).select("company_id", "fiscal_year", "complete")


@query("SELECT o_orderkey, count(l_orderkey) AS lines, count(l_orderkey) > 0 AS synced FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def synced_counts(spark, d):
    """How many children each filing has; none tells that it is not synced."""
    n = sync.counts_by_parent(loader(spark, d)("lineitem"), "l_orderkey", "lines")
    met = loader(spark, d)("orders").select("o_orderkey").join(n.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "left")
    return met.select("o_orderkey", F.coalesce("lines", F.lit(0)).cast("long").alias("lines"), F.col("lines").isNotNull().alias("synced"))


@query("SELECT s_name, 'new' AS state, CASE WHEN s_suppkey % 2 = 0 THEN 'touched' ELSE 'same' END AS touched FROM supplier")
def insert_defaults(spark, d):
    """Defaults fill what an insert leaves out; an update touches what the schema says."""
    spec = define("s", "id serial\ns_name text\ns_suppkey integer\nstate text default:new\ncreated_at timestamp default:CURRENT_TIMESTAMP\nupdated_at timestamp touch")
    empty = spark.createDataFrame([], spec.struct)
    made = wr.insert(empty, loader(spark, d)("supplier").select("s_name", "s_suppkey"), spec, ["s_suppkey"])
    changed = wr.update_where(made, {"s_name": F.col("s_name")}, F.col("s_suppkey") % 2 == 0, spec)
    return changed.where("created_at IS NOT NULL").select("s_name", "state", F.when(F.col("updated_at").isNull(), "same").otherwise("touched").alias("touched"))


@query("SELECT vec_id AS id, true AS unit FROM embeddings WHERE vec_id % 3 <> 0")
def vector_file(spark, d):
    """Vectors to a file of versions and back: unit length, a third of them removed again."""
    rows = loader(spark, d)("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    store = VectorStore(spark, _folder(spark, "vectors"))
    store.add(rows, 1)
    store.remove(rows.where("id % 3 = 0"), 2)
    size = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return store.frame().select("id", (F.abs(size - 1) < 1e-5).alias("unit"))


@query("""
SELECT lpad(CAST(s_nationkey AS VARCHAR), 10, '0') AS cik, arg_min(s_name, s_suppkey) AS name, count(*) AS symbols, round(arg_min(s_acctbal, s_suppkey), 2) AS market_cap FROM supplier WHERE s_nationkey % 5 <> 0 GROUP BY s_nationkey
""")
def company_files(spark, d):
    """Suppliers written as a screener's CSV and a ticker file, read back and merged."""
    s = loader(spark, d)("supplier")
    at = _folder(spark, "companies")
    none = lambda c: F.lit(None).cast("string").alias(c)
    rows = s.orderBy("s_suppkey").select(F.lower("s_name").alias("symbol"), F.col("s_name").alias("name"), none("country"), none("sector"), none("industry"), F.col("s_acctbal").cast("string").alias("marketCap"), none("delisted"))
    rows.coalesce(1).write.option("header", True).csv(f"{at}/screener")  # a company list is one small file
    s.where("s_nationkey % 5 <> 0").select(F.concat("s_name", F.lit("\t"), F.col("s_nationkey").cast("string"))).write.text(f"{at}/tickers")
    listed = spark.createDataFrame([], "symbol string, cik string, name string, exchange string")
    out = companies.merge_companies(companies.read_screener(spark, f"{at}/screener"), listed, companies.read_tickers(spark, f"{at}/tickers"))
    return out.select("cik", "name", F.size("symbols").cast("long").alias("symbols"), F.round("market_cap", 2).alias("market_cap"))


_ISSUE = "CASE item_id % 4 WHEN 0 THEN 'outdated' WHEN 1 THEN 'structurally_invalid' WHEN 2 THEN 'added_precision' END"


@query(f"""
SELECT CAST(item_id AS VARCHAR) AS id, CASE WHEN issue = 'structurally_invalid' THEN 'revised ' || item_id ELSE text END AS question,
       CASE WHEN issue IN ('outdated', 'incorrect_answer', 'structurally_invalid') THEN 'new' ELSE 'old' END AS ground_truth
FROM (SELECT *, {_ISSUE} AS issue FROM benchmark)
""")
def eval_questions(spark, d):
    """Questions written as a file, read back, with the variant that a mode takes."""
    i = F.col("item_id")
    issue = F.when(i % 4 == 0, "outdated").when(i % 4 == 1, "structurally_invalid").when(i % 4 == 2, "added_precision")
    at = f"{_folder(spark, 'questions')}.jsonl"
    loader(spark, d)("benchmark").select(i.cast("string").alias("id"), F.col("text").alias("question"), F.concat(F.lit("revised "), i.cast("string")).alias("revised_question"), F.lit("new").alias("ground_truth"), F.lit("old").alias("original_ground_truth"), issue.alias("issue_type")).write.json(at)
    return evals.select_mode(evals.read_questions(spark, at), "standard").select("id", "question", "ground_truth")


@query("SELECT DISTINCT upper(trim(t)) AS ticker FROM (SELECT unnest(string_split(' ' || n_name || ', r' || n_regionkey, ',')) AS t FROM nation) WHERE trim(t) <> ''")
def eval_tickers(spark, d):
    """Distinct tickers of comma-separated lists."""
    n = loader(spark, d)("nation")
    return evals.tickers(n.select(F.concat(F.lit(" "), "n_name", F.lit(", r"), F.col("n_regionkey").cast("string")).alias("ticker")))


@query("SELECT conv_id * 1000 + turn AS transcript_id, length(text) AS n FROM conversations WHERE text IS NOT NULL AND turn % 3 <> 2")
def transcript_files(spark, d):
    """Calls written as JSON lines and read back by date."""
    at = _folder(spark, "transcripts")
    c = loader(spark, d)("conversations").where("text IS NOT NULL")
    day = F.when(F.col("turn") % 3 == 2, "2023-05-01").otherwise("2024-05-01")
    c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("transcript_id"), day.alias("date"), F.col("text").alias("content")).write.json(at)
    rows = source.read_transcripts(spark, at, "2024-01-01", "2024-12-31").where("broken IS NULL")
    return rows.select("transcript_id", F.length("content").cast("long").alias("n"))
