"""Manifests and files on disk, to tables; restarts lose and double nothing."""

import json

import pytest
from pyspark.sql import functions as F

from folioquery.sources import filings as src
from folioquery.streaming import ingest
from folioquery.streaming.ingest import FilingIngest

BREAK = '<p style="page-break-after:always"></p>'


def manifest(root, name, entries):
    (root / "manifests").mkdir(exist_ok=True)
    (root / "files").mkdir(exist_ok=True)
    with open(root / "manifests" / name, "a") as f:
        for e in entries:
            f.write(e if isinstance(e, str) else json.dumps(e))
            f.write("\n")


def filing(root, k, text=None, form="8-K"):
    (root / "files").mkdir(exist_ok=True)
    (root / "files" / f"{k}.htm").write_text(text or f"<p>cover {k}</p>{BREAK}<p>news {k}</p>")
    return {"filing_id": k, "company_id": 5, "accession_number": f"a-{k}", "form": form, "items": ["9.01"], "filing_date": "2024-03-01", "path": f"files/{k}.htm"}


@pytest.fixture
def companies(spark):
    return spark.createDataFrame([(5, "Acme", ["ACM"], ["NYSE"], "Tech", None)], "id long, name string, symbols array<string>, exchanges array<string>, sector string, industry string")


def test_every_line_is_in_one_range(spark, tmp_path, monkeypatch):
    manifest(tmp_path, "m-1.jsonl", [filing(tmp_path, k) for k in range(40)] + ["no json", {"filing_id": 77, "path": "files/none.htm"}, {"filing_id": 78, "path": "../x"}, {"filing_id": 79}])
    src.register(spark)
    files = src._Files(str(tmp_path))
    for size in (1, 7, 100, 333, 1 << 20):
        monkeypatch.setattr(src, "RANGE", size)
        lines = [x for r in src._Reader(str(tmp_path)).partitions() for x in src._lines(files, r)]
        assert lines == [x.encode() for x in (tmp_path / "manifests" / "m-1.jsonl").read_text().splitlines()]
    rows = spark.read.format("filings").load(str(tmp_path)).collect()
    assert sorted(r.filing_id for r in rows if r.error is None) == list(range(40))
    assert sorted(str(r.filing_id) for r in rows if r.error) == ["77", "78", "79", "None"]
    assert next(r for r in rows if r.filing_id == 3).html.startswith("<p>cover 3")


def test_a_second_run_reads_what_is_new(spark, tmp_path, companies):
    src.register(spark)
    source, out = tmp_path / "in", f"file://{tmp_path}/out"
    source.mkdir()
    manifest(source, "m-1.jsonl", [filing(source, 1), filing(source, 2), {"filing_id": 9, "company_id": 5, "form": "8-K", "path": "files/9.htm"}])
    job = FilingIngest(spark, out, companies)
    stream = lambda: spark.readStream.format("filings").load(str(source))
    job.run(stream())
    state = lambda: {r.filing_id: (r.synced, r.num_pages, r.press_release) for r in job.read("filings").collect()}
    assert state() == {1: (True, 2, True), 2: (True, 2, True), 9: (False, None, False)} or state()[9][0] is False
    assert [(r.filing_id, r.step) for r in job.read("filing_errors").collect()] == [(9, "source")]
    manifest(source, "m-1.jsonl", [filing(source, 3)])  # a manifest grows
    manifest(source, "m-2.jsonl", [filing(source, 9), filing(source, 2, "<p>other</p>")])  # the broken one is there now; 2 is synced and stays
    job.run(stream())
    assert {k: v[:2] for k, v in state().items()} == {1: (True, 2), 2: (True, 2), 3: (True, 2), 9: (True, 2)}
    pages = job.read("filing_pages")
    assert pages.count() == 8 and pages.where("filing_id = 2 AND page = 2").first().content == "news 2"
    assert sorted(r.filing_id for r in job.read("filing_section_chunks").collect()) == [1, 2, 3, 9]


@pytest.mark.parametrize("dies_at", range(5))
def test_a_stream_that_dies_between_two_tables(spark, tmp_path, companies, monkeypatch, dies_at):
    src.register(spark)
    source = tmp_path / "in"
    source.mkdir()
    manifest(source, "m-1.jsonl", [filing(source, k) for k in range(4)])
    job = FilingIngest(spark, f"file://{tmp_path}/out", companies)
    real, left = job.table, [dies_at]

    def table(name, like=None):
        if like is not None:
            left[0] -= 1
            if left[0] < 0:
                raise RuntimeError("power cut")
        return real(name, like)

    monkeypatch.setattr(job, "table", table)
    with pytest.raises(Exception, match="power cut"):
        job.run(spark.readStream.format("filings").load(str(source)))
    assert real("filings") is None  # nothing is synced before all else is there
    monkeypatch.undo()
    job.run(spark.readStream.format("filings").load(str(source)))
    assert job.read("filing_pages").count() == 8 and job.read("filing_section_chunks").count() == 4
    assert sorted(r.filing_id for r in job.read("filings").where("synced").collect()) == [0, 1, 2, 3]
    assert job.read("filing_pages").groupBy("filing_id", "page").count().where("count > 1").count() == 0
    assert list(ingest.INGESTED)[-1] == "filings"


def test_a_page_that_cannot_be_parsed_is_an_error_row(spark, companies, monkeypatch):
    from folioquery.functions.documents import html
    from folioquery.streaming import flows

    f = spark.createDataFrame([(1, 5, "8-K", ["2.02"], "<p>a</p>"), (2, 5, "8-K", ["2.02"], "boom")], "filing_id long, company_id long, form string, items array<string>, html string")
    to_pages = html.to_pages

    def fails(text):
        if text == "boom":
            raise ValueError("unreadable")
        return to_pages(text)

    monkeypatch.setattr(html, "to_pages", fails)
    monkeypatch.setattr(flows, "_parsed", lambda rows, key: flows.flat_map(rows.select(key, "html"), lambda r: [{key: r[key], "pages": fails(r["html"])}], f"{key} long, pages {flows.PAGES}, error string", keys=[key]))
    out = flows.process(f, companies)
    assert {r.filing_id: r.synced for r in out["filings"].collect()} == {1: True, 2: False}
    assert [(r.filing_id, r.step, r.error) for r in out["filing_errors"].collect()] == [(2, "pages", "ValueError: unreadable")]


def test_transcripts(spark, tmp_path):
    at = tmp_path / "t"
    at.mkdir()
    (at / "1.json").write_text('{"transcript_id": 1, "year": 2024, "quarter": 1, "date": "2024-04-30", "content": "A: hi"}\nnot json\n{"transcript_id": 2, "date": "2025-01-31", "content": "B: ho"}\n')
    rows = src.read_transcripts(spark, str(at), "2024-01-01", "2024-12-31").collect()
    assert sorted((r.transcript_id or 0, r.broken) for r in rows) == [(0, "not json"), (1, None)]
    stream = src.read_transcripts(spark, str(at), stream=True)
    stream.where(F.col("broken").isNull()).writeStream.format("memory").queryName("calls").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("calls").count() == 2


def test_questions_as_json_lines(spark, tmp_path):
    from folioquery.sources.evals import read_questions

    (tmp_path / "q.jsonl").write_text('{"id": "1", "question": "q?", "ground_truth": "a"}\n')
    assert read_questions(spark, str(tmp_path / "q.jsonl")).first().question == "q?"
