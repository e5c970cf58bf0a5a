"""Physical plans: filters and columns reach the scan, top-k needs no full sort, no join without need."""

from folioquery.plans import registry

Q = registry.queries()


def plan(spark, sf, name):
    return Q[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_pruned_view_reads_one_table_and_three_columns(spark, sf):
    text = plan(spark, sf, "view_pruned")
    assert "Join" not in text and text.count("FileScan") == 1 and "Exchange" not in text
    assert "EqualTo(o_orderpriority,2-HIGH)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderpriority:string>" in text


def test_filters_are_pushed_through_views(spark, sf):
    text = plan(spark, sf, "view_two_way")
    assert "EqualTo(c_mktsegment,BUILDING)" in text and text.count("FileScan") == 2


def test_newest_filings_keep_only_the_top(spark, sf):
    text = plan(spark, sf, "list_filings")
    assert "TakeOrderedAndProject(limit=50" in text and "Sort [" not in text


def test_vector_search_moves_only_the_top(spark, sf):
    text = plan(spark, sf, "vec_topk")
    assert "TakeOrderedAndProject(limit=20" in text and "Exchange" not in text


def test_no_python_in_text_search(spark, sf):
    for name in ("text_keyword_bm25", "text_phrase", "pred_ilike", "pred_regex", "stmt_quarterly_view", "upsert_update"):
        text = plan(spark, sf, name)
        assert "Python" not in text and "Arrow" not in text, name


def test_keyword_searches_read_the_index_and_no_text(spark, sf):
    for name in ("text_keyword_bm25", "text_keyword_prefix", "text_phrase", "hybrid_fusion"):
        text = plan(spark, sf, name)
        assert "ReadSchema: struct<token:string" in text and "text:string" not in text, name
    assert "StartsWith" in plan(spark, sf, "text_keyword_bm25").split("PushedFilters", 1)[1]


def test_sections_are_native(spark, sf):
    text = plan(spark, sf, "sections_extract")
    assert "Python" not in text and "Arrow" not in text


def test_sections_shuffle_nothing(spark):
    from folioquery.functions.documents import sections

    filings = spark.createDataFrame([(1, "10-K", [(1, "ITEM 1. Business")])], "filing_id long, form string, pages array<struct<page:int,content:string>>")
    text = sections.extract_sections(filings)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Sort " not in text and "Window" not in text and "Join" not in text


def test_a_quarterly_view_reads_twice_and_joins_once(spark, sf):
    text = plan(spark, sf, "stmt_quarterly_view")
    assert text.count("FileScan") <= 3 and text.count("Join") <= 2 and text.count("Union") == 0 and text.count("Exchange") <= 14


def test_rows_that_are_dear_are_dealt_out_by_their_number(spark, tmp_path):
    from folioquery.plans.fixtures import spread_by_rows

    spark.range(10_000).coalesce(1).write.parquet(f"{tmp_path}/ids")
    dealt = spread_by_rows(spark.read.parquet(f"{tmp_path}/ids"), 500)
    assert dealt.rdd.getNumPartitions() == 20 and dealt.count() == 10_000
