from pyspark.sql import functions as F

from folioquery.operators.writes import MergeTable
from folioquery.sources import companies, evals
from folioquery.streaming import ingest


def test_incremental_upsert_sees_new_files_once(spark, tmp_path):
    src, like = f"file://{tmp_path}/in", spark.createDataFrame([], "k long, ts long, v string")
    table = MergeTable(spark, f"file://{tmp_path}/t", like, "k", ["ts"])
    run = lambda: ingest.incremental_upsert(spark, like, src, "k", ["ts"], table, f"file://{tmp_path}/c")
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], like.schema).write.parquet(src)
    assert sorted(map(tuple, run().select("k", "v").collect())) == [(1, "b"), (2, "c")]
    versions = table.versions()
    run()
    assert table.versions() == versions
    spark.createDataFrame([(2, 5, "d"), (1, 0, "old")], like.schema).write.mode("append").parquet(src)
    assert sorted(map(tuple, run().select("k", "v").collect())) == [(1, "b"), (2, "d")]


def test_batches_write_themselves_and_fold_as_they_outgrow_the_base(spark, tmp_path):
    like = spark.createDataFrame([], "k long, ts long, v string")
    table = MergeTable(spark, f"file://{tmp_path}/t", like, "k", ["ts"])
    assert table.read().collect() == [] and table.versions() == []
    folds, want = 0, {}
    for ts in range(1, 13):
        rows = [(k, ts, f"{k}-{ts}") for k in range(ts % 4, 40, 4)]
        want |= {k: v for k, _, v in rows}
        table.append(spark.createDataFrame(rows + rows, like.schema))
        folds += len(table.versions()) == 1 and table.versions()[0].endswith("-base")
        assert {r.k: r.v for r in table.read().collect()} == want
    assert 1 <= folds <= 6
    table.append(spark.createDataFrame([(0, 0, "old"), (None, 5, "no key")], like.schema))
    assert {r.k: r.v for r in table.read().collect()} == want | {None: "no key"}
    table.fold()
    assert len(table.versions()) == 1 and {r.k: r.v for r in table.read().collect()} == want | {None: "no key"}


def test_isolation_and_sync(spark):
    rows = spark.createDataFrame([(1, "x"), (2, None)], "id long, accession_number string")
    good, bad = ingest.isolate(rows, {"no number": F.col("accession_number").isNotNull()})
    assert [r.id for r in good.collect()] == [1] and [(r.id, r._error) for r in bad.collect()] == [(2, "no number")]
    assert ingest.unsynced(good, rows.where("id = 1")).count() == 0
    have = spark.createDataFrame([(1, 2024, 1), (1, 2024, 2)], "company_id long, fiscal_year int, quarter int")
    done = spark.createDataFrame([(1, 2024, "Q1")], "company_id long, fiscal_year int, fiscal_period string")
    assert ingest.quarters_complete(have, done).first().complete is False
    assert ingest.quarters_complete(have.where("quarter = 1"), done).first().complete is True
    assert ingest.counts_by_parent(have, "company_id", "n").first().n == 2
    boxed = spark.sql("SELECT 't' AS table_name, 'c' AS column_name, id AS row_id, 'x' AS text, cast(id AS string) AS text_sha256 FROM range(3)")
    done, left = ingest.replay(boxed, lambda d: d.withColumn("vector", F.when(F.col("row_id") > 0, F.array(F.lit(1.0)))))
    assert (done.count(), left.count()) == (2, 1)


def test_company_files(spark, tmp_path):
    (tmp_path / "s.csv").write_text("symbol,name,country,sector,industry,marketCap,delisted\n aa ,A,US,S,I,12,\nAA,second,US,S,I,1,true\nbb,B,US,S,I,x,True\ncc,C,,,,,\n")
    (tmp_path / "t.txt").write_text("bb\t77\nbad\n")
    (tmp_path / "e.json").write_text('{"fields": ["cik", "name", "ticker", "exchange"], "data": [["5", "A Inc", "aa", "NYSE"]]}')
    s = companies.read_screener(spark, str(tmp_path / "s.csv"))
    got = {r.symbol: (r.name, r.market_cap, r.delisted) for r in s.collect()}
    assert got == {"AA": ("A", 12.0, False), "BB": ("B", None, True), "CC": ("C", None, False)}
    e, t = companies.read_exchanges(spark, str(tmp_path / "e.json")), companies.read_tickers(spark, str(tmp_path / "t.txt"))
    merged = {r.cik: (r.name, r.symbols, r.exchanges) for r in companies.merge_companies(s, e, t).collect()}
    assert merged == {"0000000005": ("A Inc", ["AA"], ["NYSE"]), "0000000077": ("B", ["BB"], [])}


def test_eval_reports(spark, tmp_path):
    q = spark.createDataFrame([("1", "q", "r", " aa, BB ", "t", None, None), ("2", "q", None, None, "t", "o", "outdated")], evals.QUESTION)
    assert sorted(r.ticker for r in evals.tickers(q).collect()) == ["AA", "BB"]
    assert [r.ground_truth for r in evals.select_mode(q, "original").orderBy("id").collect()] == ["t", "o"]
    res = spark.sql("SELECT true AS correct, 0.5D AS cost_usd, 2D AS execution_time_seconds, 3L AS num_iter")
    assert "100.0 %" in evals.write_report(res, str(tmp_path / "r")) and spark.read.json(str(tmp_path / "r")).count() == 1


def test_event_windows(spark):
    e = spark.sql("SELECT TIMESTAMP '2024-01-01 00:01:00' AS ts, 'a' AS event_type UNION ALL SELECT TIMESTAMP '2024-01-01 00:02:00', 'a'")
    assert ingest.windowed_counts(e).first().n == 2
