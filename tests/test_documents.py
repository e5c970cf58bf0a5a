from hypothesis import given, settings
from hypothesis import strategies as st

from folioquery.functions.documents import chunker, html, positioned, sections, tables, transcripts

B = positioned.Box


def test_pages_and_emphasis():
    doc = '<html><head><title>t</title><script>x</script></head><body><p>Hello <b>bold</b>&nbsp;<i>it</i></p><div style="page-break-before:always">Second</div><p style="display:none">no</p><div style="page-break-after: always">more</div><p>third</p></body></html>'
    assert [p["content"] for p in html.to_pages(doc)] == ["Hello **bold** *it*", "Second\n\nmore", "third"]
    assert html.to_pages("") == html.to_pages(None) == [{"page": 1, "content": ""}]


def test_lists_and_banners():
    doc = "<ul><li>• one<li>two</ul><ol><li>a</li><li>b</li></ol><table><tr><td>Item 1A.</td><td>Risk</td></tr></table><table><tr><td>Part ii</td></tr></table><table><tr><td>•</td><td>bullet</td></tr></table>"
    assert html.to_pages(doc)[0]["content"] == "- one\n- two\n\n1. a\n2. b\n\nITEM 1A. Risk\n\nPART II\n\n- bullet"


def test_tables():
    S = tables.Span
    cells = [[S(""), S("2024", 1, 2), S("2023", 1, 2)], [S("Revenue"), S("$"), S("10"), S("$"), S("9")], [S("Margin"), S("5"), S("%"), S(""), S("")]]
    assert tables.to_markdown(cells) == "|  | 2024 | 2023 |\n|---|---|---|\n| Revenue | $ 10 | $ 9 |\n| Margin | 5 % |  |"
    two = [[S(""), S(""), S("Year"), S("")], [S(""), S("Q1"), S("Q2"), S("Q3")], [S("a"), S("1"), S("2"), S("3")]]
    assert tables.to_markdown(two).split("\n")[0] == "|  | Q1 | Year — Q2 | Q3 |"
    assert tables.to_markdown([]) == "" and tables.span("x2") == 2 and tables.span(None) == 1
    assert tables.minify("|  a |  b  c|\n| :----- | --- |\n|1|2|") == "|a|b c|\n|---|---|\n|1|2|"


def test_positioned():
    grid = [B(10 + 100 * c, 10 + 20 * r, f"{r * 10 + c}") for r in range(3) for c in range(3)]
    assert positioned.is_table(grid) and not positioned.is_table(grid[:5])
    prose = [B(10, 20 * r, "This is a long sentence. It goes on and on for a while.") for r in range(8)]
    assert not positioned.is_table(prose)
    text = positioned.text_lines([B(10, 10, "a hyphen-"), B(10, 25, "ated word"), B(10, 40, "ends."), B(10, 55, "Next"), B(10, 90, "Head", True)])
    assert text == "a hyphenated word ends.\nNext\n\n**Head**"
    assert positioned.clusters([100, 100.5, 101.2, 130], 12) == {100: 0, 100.5: 0, 101.2: 0, 130: 1}
    assert [t for t in ("5", "(1,234.5)", "$ 12", "-3%", "[7]", "\u20ac5.00", "1. Note", "see note 1 for the text", "", "()", "1a", "Q1 2024", "3.") if positioned.is_number(t)] == ["5", "(1,234.5)", "$ 12", "-3%", "[7]", "\u20ac5.00"]
    digits = [B(10 + 200 * c, 20 * r, f"see note {r} for it") for r in range(4) for c in range(2)]
    assert not positioned.is_table(digits) and not positioned.is_table([]) and positioned.Grid.of([]).texts() == []
    assert len(positioned.groups([B(0, 0, "a"), B(0, 10, "b"), B(0, 20, "c"), B(0, 90, "d")])) == 2


def filing(spark, *found):
    rows = [(i, form, [{"page": n, "content": c} for n, c in pages] if pages is not None else None) for i, (form, pages) in enumerate(found)]
    df = sections.extract_sections(spark.createDataFrame(rows, "filing_id long, form string, pages array<struct<page:int,content:string>>"))
    out = {i: [] for i in range(len(found))}
    for r in df.orderBy("filing_id", "pages").collect():
        out[r.filing_id].append((r.part, r.item, r.title, r.section, [(p.page, p.content) for p in r.pages]))
    return out, df


def test_sections(spark):
    pages = [
        (1, "ITEM 1. a\nITEM 2. b\nITEM 3. c"),
        (2, "PART I\nITEM 1. Business\nWe do.\n12\nPage 3 of 9\nITEM 1A. Risk Factors\nRisky"),
        (3, "still\nAcme Inc | 2024 Form 10-K | 3\n**PART II**\nItem 7. MD&A\nresults"),
        (4, "more\nITEM 99. Odd"),
        (6, "PART III\n" + "Incorporated by reference. " * 4),
        (7, "PART IV\nshort"),
    ]
    leaders = [(1, "a ..... 1\nb ... 12\nPART I ........ 3"), (2, "Item 7A. Market"), (3, "<b>Item 9B</b>: Other\u00a0 information\nx"), (8, "x ..... 1\ny ... 2\nz ... 3\nItems 8 and 9\nPART of it")]
    got, df = filing(spark, ("10-K", pages), ("10-K", leaders), ("10-K", [(9, "no header")]), ("20-F", [(9, "Item 5. Review")]), ("10-Q/A", [(9, "## PART II\nx\n# Item 1A \u2013 Risks\ny"), (10, None)]), (None, [(1, "Item 3. C\nz")]), ("8-K", None), ("10-K", []))
    assert got[0] == [
        ("PART I", "ITEM 1", "Business", "business", [(2, "ITEM 1. Business\nWe do.")]),
        ("PART I", "ITEM 1A", "Risk Factors", "risk_factors", [(2, "ITEM 1A. Risk Factors\nRisky"), (3, "still")]),
        ("PART II", "ITEM 7", "MD&A", "md&a", [(3, "Item 7. MD&A\nresults"), (4, "more")]),
        ("PART III", None, None, None, [(6, "PART III\n" + ("Incorporated by reference. " * 4).strip())]),
    ]
    assert [x[:4] for x in got[1]] == [("PART II", "ITEM 7A", "Market", "market_risk"), ("PART II", "ITEM 9B", "Other information", "other_information")]
    assert got[1][1][4][1] == (8, "x ..... 1\ny ... 2\nz ... 3\nItems 8 and 9\nPART of it")
    assert got[2] == got[3] == got[6] == got[7] == []
    assert got[4] == [("PART II", "ITEM 1A", "Risks", "risk_factors", [(9, "# Item 1A \u2013 Risks\ny")])]
    assert got[5] == [(None, "ITEM 3", "C", None, [(1, "Item 3. C\nz")])]
    assert sections.section_of(df, "part  i", "item 1a").first().title == "Risk Factors" and sections.section_of(df, "PART II").where("form = '10-K'").count() == 3


def test_chunks():
    md = "# Head\nFirst sentence here. Second sentence there. Third one.\n\nCaption text\n| a | b |\n| --- | --- |\n| 1 | 2 |\nAfter table."
    got = chunker.split([{"page": 1, "content": md}], "H", 14, 0)
    assert all(c["content"] for c in got) and [c["has_table"] for c in got].count(True) == 1
    assert got[0]["embedding_text"].startswith("H\n\n# Head")
    table = next(c for c in got if c["has_table"])
    assert "Caption text" in table["content"] and "|1|2|" in table["content"]
    long = "word " * 50
    assert [c["content"] for c in chunker.split([{"page": 1, "content": long.strip() + ". Next one."}], "", 10, 0)] == [long.strip() + ".", "Next one."]
    over = chunker.split([{"page": 1, "content": "One two three. Four five six. Seven eight nine."}], "", 8, 4)
    assert [c["content"] for c in over] == ["One two three. Four five six.", "Four five six.\nSeven eight nine."] and chunker.split([], "") == []


def test_transcripts():
    text = "Executives: a\nOperator: Hello all.\nJohn Smith: Hi. We did well. Very well.\nOperator: Next.\nJane: Q?\nEmpty:\n"
    turns = transcripts.parse(text)
    assert [t["speaker"] for t in turns] == ["Operator", "John Smith", "Operator", "Jane"]
    chunks = transcripts.split(turns, 1000, 500)
    assert [[t["speaker"] for t in c] for c in chunks] == [["Operator", "John Smith"], ["Operator", "Jane"]]
    small = transcripts.split(turns, 6, 4)
    assert " ".join(t["content"] for c in small for t in c if t["speaker"] == "John Smith") == "Hi. We did well. Very well."
    assert transcripts.parse(None) == [] and transcripts.split([]) == []


def test_note():
    assert html.flatten_note("<table><tr><td>a</td><td><table><tr><td>x</td></tr></table></td></tr></table>") == "a\n\nx"


def test_markup_of_any_depth(spark):
    for tag in ("b", "div", "span", "ul><li", "table><tr><td", "i", "p"):
        deep = f"<{tag}>" * 3000 + "word"
        assert "word" in html.to_pages(deep)[0]["content"] and html.retention(deep, html.to_pages(deep)) is not None
        assert "word" in html.flatten_note(deep)
    assert html.to_pages("<b>" * 50_000 + "x")[0]["content"] == "**x**" and html.to_pages("<b><i><b>x</b></i></b>")[0]["content"] == "***x***"
    assert html.to_pages("</b>" * 1000 + "<p>a" * 2000)[0]["content"] == "\n\n".join(["a"] * 2000)
    assert html.to_pages("margin-top: 2px;<p>a: b; c</p>")[0]["content"] == "a: b; c"


def test_a_failing_row_names_its_error(spark):
    from folioquery.functions.documents import flat_map

    def work(row):
        yield {"k": row["k"], "n": 10 // row["n"]}

    rows = spark.createDataFrame([(1, 2), (2, 0), (3, None), (4, 5)], "k long, n long")
    got = {r.k: (r.n, r.error) for r in flat_map(rows, work, "k long, n long, error string", keys=("k",)).collect()}
    assert got[1] == (5, None) and got[4] == (2, None) and got[2][0] is None and "ZeroDivisionError" in got[2][1] and "TypeError" in got[3][1]


def test_text_beside_positioned_boxes_keeps_its_place():
    box = '<div style="position:absolute;left:10px;top:10px">boxed</div>'
    source = f"<div>Total revenue grew strongly.{box}<p>and more text</p></div>"
    assert html.to_pages(source)[0]["content"] == "Total revenue grew strongly.\n\nboxed\n\nand more text"
    two = f"<div>{box}<span> </span>{box.replace('top:10px', 'top:90px')}after</div>"
    assert html.to_pages(two)[0]["content"].split() == ["boxed", "boxed", "after"]


def test_one_long_block_is_linear():
    import time

    began = time.perf_counter()
    text = html.assemble(["x "] * 2_000_000)
    assert len(text) == 3_999_999 and time.perf_counter() - began < 10


def test_gap_groups_are_those_of_the_splitter(spark):
    import random

    rng = random.Random(8)
    rows = []
    for page in range(60):
        top = 0.0
        for k in range(rng.randint(1, 25)):
            top += rng.choice([0, 0, 3, 12, 14, 15, 16, 40, 120])
            rows.append((page, float(rng.randint(0, 5) * 70 + k / 100), top, k))
    df = spark.createDataFrame(rows, "page long, left double, top double, k int")
    got = {(r.page, r.k): r.grp for r in positioned.gap_groups(df, ["page"]).collect()}
    for page in range(60):
        boxes = [positioned.Box(left, top, str(k)) for p, left, top, k in rows if p == page]
        for i, g in enumerate(positioned.groups(boxes)):
            assert {got[page, int(b.text)] for b in g} == {i}


def test_pages_of_attachments_are_made_behind_the_shuffle(spark):
    from folioquery.plans import registry

    plan = registry.queries()["read_attachment"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Aggregate") == 1


def test_gap_groups_keep_boxes_at_one_place_together(spark):
    df = spark.createDataFrame([(p, 0.0, float(t), k) for p in range(40) for t in (0, 20, 120, 220) for k in range(6)], "page long, left double, top double, k int")
    got = positioned.gap_groups(df.repartition(7), ["page"]).groupBy("page", "top").agg({"grp": "collect_set"}).collect()
    assert all(r[2] == [{0: 0, 20: 0, 120: 1, 220: 2}[int(r.top)]] for r in got) and len(got) == 160


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<br/>", "<br>", "<td a='1' B=2>", "</td>", "<tr>", "<table class=\"x y\">", "</table>", "<li>", "<div/>", "<div hidden>", "a &amp; b", " ", "x<y", "&nbsp;", "<!-- c -->", "<a href=/x>", "<script>if (a<b) '<p>'</script>", "<", ">", "é"]), max_size=14))
def test_plain_markup_gives_the_tree_of_the_standard_tokenizer(pieces):
    source = "".join(pieces)
    slow = html._Tree()
    slow.feed(source)
    slow.close()
    fast = html._Tree()
    if html._plain(fast, source):
        same = lambda a, b: a == b if isinstance(a, str) or isinstance(b, str) else (a.name, a.attrs) == (b.name, b.attrs) and len(a.children) == len(b.children) and all(map(same, a.children, b.children))
        assert same(fast.root, slow.root)
