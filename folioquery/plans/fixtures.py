"""A catalog over the star-schema tables, which stand in for companies, filings and their pages."""

from __future__ import annotations

import contextlib
import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fulltext import TextIndex
from ..operators.pivots import PivotIndex
from ..operators.query import Database
from ..operators.schema import Catalog, ViewSpec, define
from ..operators.substrings import SubstringIndex
from ..storage import Folder, WriteConflict, shared_dir

_DOCUMENTS = "doc_id serial\ntext text fts vector\nlang text\nsource text\nn_chars integer"
TABLES = (
    define("region", "r_regionkey serial\nr_name text"),
    define("nation", "n_nationkey serial\nn_name text\nn_regionkey integer fk:region.r_regionkey"),
    define("customer", "c_custkey serial\nc_name text\nc_nationkey integer fk:nation.n_nationkey\nc_acctbal float\nc_mktsegment text"),
    define("orders", "o_orderkey serial\no_custkey integer fk:customer.c_custkey\no_orderstatus text\no_totalprice float\no_orderdate timestamp\no_orderpriority text"),
    define("lineitem", "l_orderkey integer fk:orders.o_orderkey\nl_partkey integer\nl_suppkey integer\nl_linenumber integer\nl_quantity float\nl_extendedprice float\nl_discount float\nl_tax float\nl_returnflag text\nl_linestatus text\nl_shipdate timestamp"),
    define("part", "p_partkey serial\np_name text\np_brand text\np_type text\np_size integer\np_retailprice float"),
    define("events", "event_id serial\nts timestamp\nuser_id integer\nevent_type text\nvalue float\nprops json"),
    define("documents", _DOCUMENTS),
    define("labels", "doc_id integer fk:documents.doc_id\nquality integer\ntoxic integer"),
    define("customer_tags", "c_custkey serial\ntags json as:array<string>\nyears json as:array<bigint>"),
)


def _view(name: str, tables: str, columns: str) -> ViewSpec:
    pairs = [(a, *s.split(".")) for a, s in (x.split("=") for x in columns.split())]
    return ViewSpec(name, tuple(tables.split()), tuple(pairs))


VIEWS = (
    _view("filings_view", "orders customer", "id=orders.o_orderkey form=orders.o_orderpriority filing_date=orders.o_orderdate amount=orders.o_totalprice company_id=orders.o_custkey company_name=customer.c_name company_sector=customer.c_mktsegment"),
    _view("filings_by_country", "orders customer nation", "id=orders.o_orderkey amount=orders.o_totalprice company_name=customer.c_name country=nation.n_name"),
    _view("filings_by_region", "orders customer nation region", "id=orders.o_orderkey form=orders.o_orderpriority amount=orders.o_totalprice company_name=customer.c_name country=nation.n_name region=region.r_name"),
    _view("pages_view", "lineitem orders customer", "filing_id=lineitem.l_orderkey page=lineitem.l_linenumber amount=lineitem.l_extendedprice filing_date=orders.o_orderdate company_name=customer.c_name"),
    _view("companies_with_filings", "customer orders", "company_id=customer.c_custkey company_name=customer.c_name filing_id=orders.o_orderkey"),
    _view("labelled_docs", "documents labels", "id=documents.doc_id lang=documents.lang quality=labels.quality toxic=labels.toxic"),
    _view("docs", "documents", "id=documents.doc_id content=documents.text embedding=documents.text lang=documents.lang source=documents.source n_chars=documents.n_chars"),
)


def star_catalog() -> Catalog:
    out = Catalog()
    for t in TABLES:
        out = out.add_table(t)
    out.validate()
    for v in VIEWS:
        out = out.add_view(v)
    return out


def loader(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    def load(name: str) -> DataFrame:
        if name == "customer_tags":  # arrays, built from orders
            orders = load("orders").select("o_custkey", "o_orderstatus", F.year("o_orderdate").cast("long").alias("y"))
            return orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_set("o_orderstatus")).alias("tags"), F.array_sort(F.collect_set("y")).alias("years"))
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    return load


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores where a small table has fewer splits, for work that is dear by the row.

    For scans: to count the partitions of what a shuffle gives, Spark would run that shuffle, and again with the query.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def spread_by_rows(df: DataFrame, rows: int = 1 << 17) -> DataFrame:
    """Scanned rows dealt out so that a task has about ``rows`` of them, for work that is dear by the row over narrow columns: splits are cut by bytes."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)))


def text_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The stored index of the documents' texts, built at first use; files that were written anew get an index of their own."""
    source = Folder(spark, f"{sf_dir}/documents.parquet")
    index = TextIndex(spark, f"{shared_dir(spark)}/text-runs-{hashlib.sha256(f'{sf_dir} {source.stamp()}'.encode()).hexdigest()[:24]}")
    if not index.exists:
        with contextlib.suppress(WriteConflict):  # another session has just built it
            index.update(loader(spark, sf_dir)("documents"), "doc_id", "text")
    return index


def substring_index(spark: SparkSession, sf_dir: str) -> SubstringIndex:
    """The stored substring index of the documents' texts, likewise."""
    source = Folder(spark, f"{sf_dir}/documents.parquet")
    index = SubstringIndex(spark, f"{shared_dir(spark)}/substrings-{hashlib.sha256(f'{sf_dir} {source.stamp()}'.encode()).hexdigest()[:24]}")
    if not index.exists:
        index.update(loader(spark, sf_dir)("documents"), "doc_id", "text")
    return index


def pivot_index(spark: SparkSession, sf_dir: str) -> PivotIndex:
    """The stored index of the embeddings, likewise."""
    source = Folder(spark, f"{sf_dir}/embeddings.parquet")
    index = PivotIndex(spark, f"{shared_dir(spark)}/vector-groups-{hashlib.sha256(f'{sf_dir} {source.stamp()}'.encode()).hexdigest()[:24]}")
    if not index.exists:
        with contextlib.suppress(WriteConflict):
            index.build(loader(spark, sf_dir)("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))
    return index


def database(spark: SparkSession, sf_dir: str, pivots: bool = False) -> Database:
    """The star schema's tables; ``pivots``: vector searches go by the pivot index."""
    load = loader(spark, sf_dir)
    vectors = lambda table, column: pivot_index(spark, sf_dir) if pivots else load("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    indexes = lambda table, column: text_index(spark, sf_dir) if (table, column) == ("documents", "text") else None
    substrings = lambda table, column: substring_index(spark, sf_dir) if (table, column) == ("documents", "text") else None
    return Database(star_catalog(), load, vectors, indexes=indexes, substrings=substrings)


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """One stored vector, as the query."""
    row = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row[0]]
