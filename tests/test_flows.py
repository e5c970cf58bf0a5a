from folioquery.streaming import flows

BREAK = '<p style="page-break-after:always"></p>'
TENK = f"<p>PART I</p><p>ITEM 1. Business</p><p>We sell.</p>{BREAK}<p>ITEM 1A. Risk Factors</p><p>Risky.</p><p>PART II</p><p>ITEM 7. Analysis</p><p>Fine.</p>"
EIGHTK = f"<p>cover</p>{BREAK}<p>news</p>"


def batch(spark):
    f = spark.createDataFrame([(1, 5, "10-K", None, TENK, 2024, "FY", "2024-02-01", "2023-12-31"), (2, 5, "8-K/A", ["2.02", "9.01"], EIGHTK, None, None, "2024-03-01", None), (3, 9, "DEF 14A", None, "<p>vote</p>", None, None, "2024-04-01", None), (4, 5, "6-K", None, EIGHTK, None, None, None, None)], "filing_id long, company_id long, form string, items array<string>, html string, fiscal_year int, fiscal_period string, filing_date string, report_date string")
    c = spark.createDataFrame([(5, "Acme", ["ACM"], ["NYSE"], "Tech", None)], "id long, name string, symbols array<string>, exchanges array<string>, sector string, industry string")
    return f, c


def test_process(spark):
    f, c = batch(spark)
    out = flows.process(f, c)
    chunks = {(r.filing_id, r.section): r for r in out["filing_section_chunks"].collect()}
    assert set(chunks) == {(1, "business"), (1, "risk_factors"), (1, "md&a"), (2, "current_report"), (3, "proxy_statement"), (4, "current_report")}
    text = chunks[1, "business"].embedding
    assert text.startswith("# Acme (ACM - NYSE)\nSector: Tech\nForm 10-K | FY 2024 | Filed: 2024-02-01 | Period Ending: 2023-12-31\n\n## Business\n") and "We sell." in text
    assert "cover" not in chunks[2, "current_report"].embedding and "news" in chunks[4, "current_report"].embedding
    got = {r.filing_id: (r.press_release, r.num_pages, r.synced) for r in out["filings"].collect()}
    assert got == {1: (False, 2, True), 2: (True, 2, True), 3: (False, 1, True), 4: (False, 2, True)}
    assert out["filing_pages"].count() == 7
    assert {(r.section, r.page) for r in out["filing_section_pages"].collect()} == {("business", 1), ("risk_factors", 2), ("md&a", 2)}


def test_attachments_and_notes(spark):
    f, c = batch(spark)
    files = spark.createDataFrame([(7, 1, "99.1", "a.htm", "Release", "<p>hello</p>"), (8, 1, "21", "b.htm", None, "<p>subs</p>")], "attachment_id long, filing_id long, exhibit_number string, filename string, description string, html string")
    out = flows.attachments(files, f, c)
    assert {r.id: r.type for r in out["filing_attachments"].collect()} == {7: "press_or_investor", 8: "subsidiaries"}
    assert [(r.attachment_id, "## Exhibit 99.1 - Press Or Investor - Release" in r.embedding) for r in out["filing_attachment_chunks"].collect()] == [(7, True)]
    assert out["filing_attachment_pages"].count() == 2
    note = spark.createDataFrame([(1, 1, "Debt", "R2.htm", "<table><tr><td>We owe.</td></tr></table>")], "note_id long, filing_id long, title string, filename string, html string")
    got = flows.notes(note, f, c)
    assert got["filing_notes"].first().content == "We owe." and "## Debt" in got["filing_note_chunks"].first().embedding
