"""The catalog of companies, filings, statements, notes, sections, attachments and transcripts."""

from __future__ import annotations

from .schema import Catalog, TableSpec, ViewSpec, define

_TIMES = """
created_at timestamp ! default:CURRENT_TIMESTAMP
updated_at timestamp ! default:CURRENT_TIMESTAMP touch
"""
_COMPANY = "company_id integer ! fk:companies.id index"
_FILING = "filing_id integer ! fk:filings.id index"
_PAGES = "as:array<struct<page:int,content:string>>"
# Choices of the enumerated columns.
_PERIODS = "of:Q1|Q2|Q3|Q4|FY"
_FORMS = "of:10-K|10-Q|8-K|DEF~14A|6-K|20-F|10-K/A|10-Q/A|8-K/A|DEF~14A/A|6-K/A|20-F/A"
_SECTIONS = "of:business|risk_factors|properties|legal_proceedings|market_equity_matters|selected_financial_data|md&a|market_risk|controls_procedures|other_information|unregistered_sales_equity|other"
_EXHIBITS = "of:underwriting_agreement|merger_agreement|certificate_of_designations|charter|bylaws|indenture|supplemental_indenture|debt_instrument|material_contract|press_or_investor|subsidiaries|legal_opinion|consent|other"
_STATEMENTS = "of:income_statement|balance_sheet|cash_flow|equity_statement|comprehensive_income"


def _table(name: str, body: str, *uniques: tuple[str, ...]) -> TableSpec:
    return define(name, "id serial\n" + body + _TIMES, *uniques)


TABLES = (
    _table("companies", """
        name text !
        symbols json ! index as:array<string>
        exchanges json index as:array<string>
        cik text ! unique index
        sic text
        sector text
        industry text
        country text
        market_cap float
        fiscal_year_end text
        delisted boolean ! default:false
        synced boolean default:false
    """),
    _table("filings", f"""
        form enum ! index {_FORMS}
        amendment boolean ! default:false
        items json as:array<string>
        press_release boolean ! default:false
        fiscal_year integer index
        fiscal_period enum {_PERIODS}
        filing_date date !
        report_date date
        accession_number text ! unique index
        num_pages integer
        num_attachments integer
        title text fts
        summary text fts vector
        synced boolean ! default:false index
        {_COMPANY}
    """),
    _table("financial_statements", f"""
        type enum ! index {_STATEMENTS}
        data json ! as:array<struct<concept:string,label:string,axis:string,member:string,period:string,level:int,dimension:boolean,abstract:boolean,value:double>>
        {_FILING}
        {_COMPANY}
    """, ("filing_id", "type")),
    _table("filing_notes", f"""
        title text !
        preview text
        filename text !
        content text ! fts
        {_FILING}
        {_COMPANY}
    """, ("filing_id", "filename")),
    _table("filing_note_chunks", f"""
        index integer !
        content text ! fts
        embedding text ! fts vector
        has_table boolean ! default:false index
        filing_note_id integer ! fk:filing_notes.id index
        {_FILING}
        {_COMPANY}
    """, ("filing_note_id", "index")),
    _table("filing_section_pages", f"""
        section enum ! index {_SECTIONS}
        page integer ! index
        content text ! fts
        has_table boolean default:false index
        {_FILING}
        {_COMPANY}
    """, ("filing_id", "section", "page")),
    _table("filing_section_chunks", f"""
        section enum ! index {_SECTIONS}|current_report|proxy_statement
        index integer !
        page integer ! index
        pages json ! {_PAGES}
        embedding text ! fts vector
        has_table boolean default:false index
        {_FILING}
        {_COMPANY}
    """, ("filing_id", "section", "index")),
    _table("filing_pages", f"""
        page integer ! index
        content text ! fts
        {_FILING}
        {_COMPANY}
    """, ("filing_id", "page")),
    _table("filing_attachments", f"""
        exhibit_number text ! index
        filename text !
        description text
        num_pages integer
        type enum ! default:other index {_EXHIBITS}
        title text fts
        summary text fts vector
        {_FILING}
        {_COMPANY}
    """, ("filing_id", "exhibit_number")),
    _table("filing_attachment_pages", f"""
        page integer ! index
        content text ! fts
        attachment_id integer ! fk:filing_attachments.id index
        {_FILING}
        {_COMPANY}
    """, ("attachment_id", "page")),
    _table("filing_attachment_chunks", f"""
        index integer !
        page integer !
        pages json ! {_PAGES}
        embedding text ! fts vector
        has_table boolean ! default:false index
        attachment_id integer ! fk:filing_attachments.id index
        {_FILING}
        {_COMPANY}
    """, ("attachment_id", "index")),
    _table("earnings_transcripts", f"""
        date timestamp
        fiscal_year integer !
        fiscal_period enum ! {_PERIODS}
        sections json ! as:array<struct<speaker:string,content:string>>
        synced boolean default:false
        {_COMPANY}
    """, ("company_id", "fiscal_year", "fiscal_period")),
    _table("earnings_transcript_chunks", f"""
        index integer !
        sections json ! as:array<struct<speaker:string,content:string>>
        embedding text ! fts vector
        transcript_id integer ! fk:earnings_transcripts.id index
        {_COMPANY}
    """, ("transcript_id", "index")),
)

# Columns that most views take from filings and companies.
_FROM_FILING = "form amendment items press_release fiscal_year fiscal_period filing_date report_date accession_number"
_FROM_COMPANY = "name symbols exchanges sector industry"


def _view(name: str, tables: str, own: str, filing: str = "", company: str = _FROM_COMPANY, also: str = "") -> ViewSpec:
    """``own`` columns come from the base; company columns get the prefix ``company_``; ``also`` lists alias=table.field."""
    order = tables.split()
    columns = [(c.split("=")[0], order[0], c.split("=")[-1]) for c in own.split()]
    columns += [(a, *s.split(".")) for a, s in (x.split("=") for x in also.split())]
    columns += [(c, "filings", c) for c in filing.split()]
    columns += [(f"company_{c}", "companies", c) for c in company.split()]
    return ViewSpec(name, tuple(order), tuple(columns))


_SHORT = _FROM_FILING.replace("items press_release ", "")
_NO_PRESS = _FROM_FILING.replace("press_release ", "")
VIEWS = (
    _view("company_filings", "filings companies", f"id {_FROM_FILING} title summary num_pages num_attachments company_id created_at updated_at", company=f"{_FROM_COMPANY} delisted"),
    _view("company_filing_pages", "filing_pages filings companies", "id page content filing_id company_id", f"{_FROM_FILING} title"),
    _view("company_filing_notes", "filing_notes filings companies", "id title filename content filing_id company_id", _FROM_FILING),
    _view("company_filing_note_chunks", "filing_note_chunks filing_notes filings companies", "id index content embedding has_table filing_note_id filing_id company_id", _SHORT, "name symbols", "note_title=filing_notes.title note_filename=filing_notes.filename"),
    _view("company_filing_section_chunks", "filing_section_chunks filings companies", "id section index page pages embedding has_table filing_id company_id", _FROM_FILING),
    _view("company_financial_statements", "financial_statements filings companies", "id type data filing_id company_id", _SHORT, "name symbols cik"),
    _view("company_filing_attachments", "filing_attachments filings companies", "id exhibit_number filename description title num_pages attachment_type=type filing_id company_id", _NO_PRESS),
    _view("company_filing_attachment_pages", "filing_attachment_pages filing_attachments filings companies", "id page content attachment_id filing_id company_id", _NO_PRESS, also="exhibit_number=filing_attachments.exhibit_number attachment_filename=filing_attachments.filename attachment_description=filing_attachments.description attachment_type=filing_attachments.type"),
    _view("company_filing_attachment_chunks", "filing_attachment_chunks filing_attachments filings companies", "id index page pages embedding has_table attachment_id filing_id company_id", _NO_PRESS, also="exhibit_number=filing_attachments.exhibit_number attachment_filename=filing_attachments.filename attachment_description=filing_attachments.description attachment_type=filing_attachments.type"),
    _view("company_earnings_transcript_chunks", "earnings_transcript_chunks earnings_transcripts companies", "id index sections embedding transcript_id company_id", also="fiscal_year=earnings_transcripts.fiscal_year fiscal_period=earnings_transcripts.fiscal_period date=earnings_transcripts.date"),
)


def catalog() -> Catalog:
    out = Catalog()
    for t in TABLES:
        out = out.add_table(t)
    out.validate()
    for v in VIEWS:
        out = out.add_view(v)
    return out.reserve_names({"vector_outbox"})
