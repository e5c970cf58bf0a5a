"""Section extraction: PART and ITEM headers carried over pages, within a filing's row.

Lines become words without markup; a line's first words tell whether it is a header, a page number or a running title. Headers cut the array of
lines into sections, the running part is the last one seen, and a section's lines are put together again by page. All is built-in expressions over the
row's arrays, so nothing is shuffled or sorted. Each step is a column of its own, as functions over array elements compute what they repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Which items each part of a form has.
STRUCTURE = {
    "10-K": {
        "PART I": ["ITEM 1", "ITEM 1A", "ITEM 1B", "ITEM 1C", "ITEM 2", "ITEM 3", "ITEM 4"],
        "PART II": ["ITEM 5", "ITEM 6", "ITEM 7", "ITEM 7A", "ITEM 8", "ITEM 9", "ITEM 9A", "ITEM 9B", "ITEM 9C"],
        "PART III": ["ITEM 10", "ITEM 11", "ITEM 12", "ITEM 13", "ITEM 14"],
        "PART IV": ["ITEM 15", "ITEM 16"],
    },
    "10-Q": {
        "PART I": ["ITEM 1", "ITEM 2", "ITEM 3", "ITEM 4"],
        "PART II": ["ITEM 1", "ITEM 1A", "ITEM 2", "ITEM 3", "ITEM 4", "ITEM 5", "ITEM 6"],
    },
    "20-F": {
        "PART I": ["ITEM 1", "ITEM 2", "ITEM 3", "ITEM 4", "ITEM 5", "ITEM 6", "ITEM 7", "ITEM 8", "ITEM 9", "ITEM 10", "ITEM 11", "ITEM 12", "ITEM 12D"],
        "PART II": ["ITEM 13", "ITEM 14", "ITEM 15", "ITEM 16", "ITEM 16A", "ITEM 16B", "ITEM 16C", "ITEM 16D", "ITEM 16E", "ITEM 16F", "ITEM 16G", "ITEM 16H", "ITEM 16I"],
        "PART III": ["ITEM 17", "ITEM 18", "ITEM 19"],
    },
}
# Names of sections, by form and item, or by form, part and item.
NAMES = {
    ("10-K", "ITEM 1"): "business",
    ("10-K", "ITEM 1A"): "risk_factors",
    ("10-K", "ITEM 2"): "properties",
    ("10-K", "ITEM 3"): "legal_proceedings",
    ("10-K", "ITEM 5"): "market_equity_matters",
    ("10-K", "ITEM 7"): "md&a",
    ("10-K", "ITEM 7A"): "market_risk",
    ("10-K", "ITEM 9A"): "controls_procedures",
    ("10-K", "ITEM 9B"): "other_information",
    ("10-Q", "PART I", "ITEM 2"): "md&a",
    ("10-Q", "PART I", "ITEM 3"): "market_risk",
    ("10-Q", "PART I", "ITEM 4"): "controls_procedures",
    ("10-Q", "PART II", "ITEM 1"): "legal_proceedings",
    ("10-Q", "PART II", "ITEM 1A"): "risk_factors",
    ("10-Q", "PART II", "ITEM 2"): "unregistered_sales_equity",
    ("20-F", "ITEM 3"): "risk_factors",
    ("20-F", "ITEM 4"): "business",
    ("20-F", "ITEM 5"): "md&a",
    ("20-F", "ITEM 11"): "market_risk",
    ("20-F", "ITEM 16"): "controls_procedures",
    ("20-F", "ITEM 16A"): "controls_procedures",
    ("20-F", "ITEM 16B"): "controls_procedures",
    ("20-F", "ITEM 16C"): "controls_procedures",
    ("20-F", "ITEM 16D"): "controls_procedures",
    ("20-F", "ITEM 16E"): "controls_procedures",
    ("20-F", "ITEM 16F"): "controls_procedures",
    ("20-F", "ITEM 16G"): "controls_procedures",
    ("20-F", "ITEM 16H"): "controls_procedures",
    ("20-F", "ITEM 16I"): "controls_procedures",
}
# A part without items needs more characters than this; contents are among the first pages and have so many entries.
STUB, CONTENTS_PAGES, CONTENTS_ROWS = 80, 5, 3
_DIGITS = "0123456789"


def _without(text: Column, wrap: str) -> Column:
    """Without one emphasis mark at each end."""
    text = F.when(text.startswith(wrap), F.ltrim(F.substring(text, len(wrap) + 1, 1 << 30))).otherwise(text)
    return F.when(text.endswith(wrap), F.rtrim(F.left(text, F.length(text) - len(wrap)))).otherwise(text)


def _number(word: Column) -> Column:
    """Whether a word is digits alone."""
    return (word != "") & (F.translate(word, _DIGITS, "") == "")


def _word(words: Column, i: int) -> Column:
    return F.coalesce(F.get(words, F.lit(i)), F.lit(""))


def _is_page_number(words: Column) -> Column:
    """A number alone, or "Page 3", or "Page 3 of 9"."""
    n = F.size(words)
    page = (_word(words, 0) == "page") & _number(_word(words, 1))
    return ((n == 1) & _number(_word(words, 0))) | (page & (n == 2)) | (page & (n == 4) & (_word(words, 2) == "of") & _number(_word(words, 3)))


def _is_running_title(line: Column) -> Column:
    """Three cells: a name that begins with a capital or nothing, "2024 Form 10-K", a page number."""
    cells = F.transform(F.split(line, r"\|"), lambda c: F.btrim(c))
    middle = F.split(F.get(cells, F.lit(1)), r"\s+")
    name = F.left(F.get(cells, F.lit(0)), F.lit(1))
    form = (F.length(_word(middle, 0)) == 4) & _number(_word(middle, 0)) & (_word(middle, 1) == "Form") & _word(middle, 2).isin("10-K", "10-Q") & (F.size(middle) == 3)
    return F.coalesce((F.size(cells) == 3) & _number(F.get(cells, F.lit(2))) & form & ((name == "") | name.between("A", "Z")), F.lit(False))


def _item_number(line: Column) -> Column:
    """"7A" of "Item 7a. ..."; empty without a number after the first four characters."""
    return F.upper(F.regexp_extract(F.ltrim(F.substring(line, 5, 1 << 30)), "^([0-9]{1,2}[A-Za-z]?)(?![A-Za-z0-9_])", 1))


def _has_leader(line: Column) -> Column:
    """Dots, then a page number of up to four digits, at the end."""
    dots = line.contains("...")
    line = F.rtrim(line)
    bare = F.rtrim(line, F.lit(_DIGITS))
    return dots & (F.length(line) - F.length(bare)).between(1, 4) & F.rtrim(bare).endswith("...")


def _spaced(text: Column) -> Column:
    """Unusual spaces as plain ones, zero-width ones away."""
    return F.translate(text, "\u00a0\u202f\t\r\u200b", "    ")


def part_of(form: Column, item: Column) -> Column:
    """The part that an item belongs to by its number; null for other forms."""
    n = F.regexp_extract(item, "[0-9]+", 0).try_cast("int")
    out = F.when((form == "10-Q") & n.isNotNull(), F.when(n.between(1, 4), "PART I").otherwise("PART II"))
    for part, items in STRUCTURE["10-K"].items():
        out = out.when((form == "10-K") & F.concat(F.lit("ITEM "), n.cast("string")).isin(items), part)
    return out


def name_of(form: Column, part: Column, item: Column) -> Column:
    """The section's name, or null."""
    out = F.lit(None).cast("string")
    for (of, *where), name in NAMES.items():
        hit = (form == of) & (item == where[-1])
        out = F.when(hit if len(where) == 1 else hit & (part == where[0]), name).otherwise(out)
    return out


def _lines_of(filings: DataFrame) -> DataFrame:
    """(filing_id, form, lines): per filing the lines (page, line, part, item, title) that are no running titles or page numbers, with what headers they hold.

    ``part`` is "PART II" and ``item`` "ITEM 7A" on header lines; ``title`` is the rest of an item's line. Contents pages are left out.
    """
    split = F.transform("pages", lambda p: F.struct(p["page"].alias("page"), F.split(_spaced(F.coalesce(p["content"], F.lit(""))), "\n").alias("lines")))
    out = filings.select("filing_id", "form", F.array_sort(split).alias("p"))
    # contents are told within a page, before its lines part
    entry = lambda x: (F.upper(F.left(F.ltrim(x), F.lit(4))) == "ITEM") & (_item_number(F.ltrim(x)) != "")
    few = lambda lines, test: F.size(F.filter(lines, test)) < CONTENTS_ROWS
    body_pages = F.filter("p", lambda p: (p["page"] > CONTENTS_PAGES) | (few(p["lines"], entry) & few(p["lines"], _has_leader)))
    out = out.select("filing_id", "form", body_pages.alias("p"))
    # what is dear is looked at only where the line's ends allow it
    first = lambda x: F.lower(F.left(F.ltrim(x), F.lit(1)))
    words = lambda x: F.when(first(x).between("0", "9") | (first(x) == "p"), F.split(F.lower(F.btrim(x)), " +"))
    each = F.transform("p", lambda p: F.transform(p["lines"], lambda x: F.struct(p["page"].alias("page"), x.alias("raw"), words(x).alias("words"))))
    out = out.select("filing_id", "form", F.flatten(each).alias("x"))
    number = lambda x: F.coalesce(_is_page_number(x["words"]), F.lit(False))
    said = F.filter("x", lambda x: (x["words"].isNull() | ~number(x)) & ~(x["raw"].contains("|") & _is_running_title(x["raw"])))

    def line(raw: Column) -> Column:
        text = F.btrim(raw)
        marked = F.left(text, F.lit(2)).isin("**", "__") | F.right(text, F.lit(2)).isin("**", "__")
        return F.when(marked, _without(_without(text, "**"), "__")).otherwise(text)

    # a heading may stand behind # marks, emphasis and tags
    bare = lambda t: F.when(t.startswith("<"), F.ltrim(F.regexp_replace(t, "^(<[^>]*> *)+", ""))).otherwise(t)
    shown = F.transform(said, lambda x: F.struct(x["page"].alias("page"), line(x["raw"]).alias("line"), F.ltrim(line(x["raw"]), F.lit("#*_ ")).alias("bare")))
    out = out.select("filing_id", "form", shown.alias("x"))

    def told(x: Column) -> Column:
        text = bare(x["bare"])
        may = F.upper(F.left(text, F.lit(4)))
        head = F.when(may.isin("PART", "ITEM"), F.upper(F.split_part(text, F.lit(" "), F.lit(1))))
        after = F.upper(F.split_part(F.ltrim(F.substring(text, 5, 1 << 30)), F.lit(" "), F.lit(1)))
        part = F.when((head == "PART") & (after != "") & (F.translate(after, "IVXLC", "") == ""), F.concat(F.lit("PART "), after))
        number = F.when(head == "ITEM", _item_number(text)).otherwise("")
        rest = F.regexp_replace(F.substring(F.ltrim(F.substring(text, 5, 1 << 30)), F.length(number) + 1, F.lit(1 << 30)), "<[^>]*>", "")
        title = F.regexp_replace(F.btrim(F.ltrim(rest, F.lit(" .:-\u2013\u2014"))), " +", " ")
        item = F.when(number != "", F.concat(F.lit("ITEM "), number))
        none = F.lit(None).cast("string")
        plain = F.struct(x["page"].alias("page"), x["line"].alias("line"), none.alias("part"), none.alias("item"), none.alias("title"))
        header = F.struct(x["page"].alias("page"), x["line"].alias("line"), part.alias("part"), item.alias("item"), F.when(number != "", F.nullif(title, F.lit(""))).alias("title"))
        return F.when(may.isin("PART", "ITEM"), header).otherwise(plain)

    return out.select("filing_id", "form", F.transform("x", told).alias("lines"))


def extract_sections(filings: DataFrame) -> DataFrame:
    """From (filing_id, form, pages) one row a section: (filing_id, form, part, item, title, section, pages).

    A PART starts anew without an item; if the next header is an ITEM on the same page, the part's line is only that item's heading. The part of
    an item is the last one stated, else what the number of the filing's first item tells. Lines before any header are dropped. Every row is a
    filing. A null page list or content has no sections.
    """
    base = F.regexp_replace("form", "/A$", "")
    lines = _lines_of(filings)
    at = F.filter(F.transform("lines", lambda x, i: F.when(x["part"].isNotNull() | x["item"].isNotNull(), i)), lambda i: i.isNotNull())
    lines = lines.select("filing_id", "form", "lines", at.alias("at"))
    heads = F.transform("at", lambda i: F.struct(F.get("lines", i)["part"].alias("part"), F.get("lines", i)["item"].alias("item"), F.get("lines", i)["title"].alias("title"), F.get("lines", i)["page"].alias("page")))
    lines = lines.withColumn("heads", heads)
    known = lambda values: F.filter(values, lambda v: v.isNotNull())

    def section(h: Column, j: Column) -> Column:
        before = F.slice("heads", F.lit(1), j + 1)
        stated = F.try_element_at(known(F.transform(before, lambda x: x["part"])), F.lit(-1))
        guessed = F.get(known(F.transform(before, lambda x: part_of(base, x["item"]))), F.lit(0))
        after = F.get("heads", j + 1)
        heading = h["item"].isNull() & F.coalesce(after["item"].isNotNull() & (after["page"] == h["page"]), F.lit(False))
        own = F.slice("lines", F.get("at", j) + 1, F.coalesce(F.get("at", j + 1), F.size("lines")) - F.get("at", j))
        return F.struct(F.coalesce(stated, guessed).alias("part"), h["item"].alias("item"), h["title"].alias("title"), heading.alias("heading"), own.alias("lines"))

    found = lines.select("filing_id", "form", F.explode(F.transform("heads", section)).alias("s")).where("NOT s.heading").select("filing_id", "form", "s.part", "s.item", "s.title", "s.lines")
    content = lambda p: F.btrim(F.array_join(F.transform(F.filter("lines", lambda x: x["page"] == p), lambda x: x["line"]), "\n"), F.lit(" \n"))
    pages = F.transform(F.array_distinct(F.transform("lines", lambda x: x["page"])), lambda p: F.struct(p.cast("int").alias("page"), content(p).alias("content")))
    out = found.select("filing_id", "form", "part", "item", "title", F.filter(pages, lambda p: p["content"] != "").alias("pages")).where(F.size("pages") > 0)
    size = F.aggregate("pages", F.lit(0), lambda total, p: total + F.length(p["content"]))
    out = out.where(F.col("item").isNotNull() | (size > STUB))
    allowed = ~base.isin(*STRUCTURE)
    for form, of in STRUCTURE.items():
        for part, items in of.items():
            allowed = allowed | ((base == form) & (F.col("part") == part) & (F.col("item").isNull() | F.col("item").isin(items)))
    out = out.where(F.coalesce(allowed, F.col("form").isNull()))
    return out.select("filing_id", "form", "part", "item", "title", name_of(base, F.col("part"), F.col("item")).alias("section"), "pages")


def section_of(sections: DataFrame, part: str, item: str | None = None) -> DataFrame:
    """The rows of a part's, or a part's item's, sections; case and spaces do not matter."""
    norm = lambda s: " ".join(s.upper().split())
    found = sections.where(F.col("part") == norm(part))
    return found if item is None else found.where(F.col("item") == norm(item))


def attachment_type(exhibit: Column) -> Column:
    """The type of an exhibit from its number."""
    head, tail = F.split_part(exhibit, F.lit("."), F.lit(1)), F.split_part(exhibit, F.lit("."), F.lit(2))
    # Exhibit numbers.
    sub = {"2": ({"1": "merger_agreement"}, "other"), "3": ({"1": "certificate_of_designations", "2": "bylaws"}, "charter"), "4": ({"1": "indenture", "2": "supplemental_indenture"}, "debt_instrument")}
    whole = {"1": "underwriting_agreement", "5": "legal_opinion", "10": "material_contract", "21": "subsidiaries", "23": "consent", "99": "press_or_investor"}
    out = F.lit("other")
    for n, kind in whole.items():
        out = F.when(head == n, kind).otherwise(out)
    for n, (kinds, rest) in sub.items():
        inner = F.lit(rest)
        for m, kind in kinds.items():
            inner = F.when(tail == m, kind).otherwise(inner)
        out = F.when(head == n, inner).otherwise(out)
    return out


# Exhibits whose pages are chunked.
CHUNKABLE = ("underwriting_agreement", "merger_agreement", "certificate_of_designations", "indenture", "supplemental_indenture", "debt_instrument", "press_or_investor")
