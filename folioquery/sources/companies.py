"""Company master data: screener CSV, ticker file, exchange file, and their merge by CIK."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCREENER = "symbol string, name string, country string, sector string, industry string, marketCap string, delisted string"


def read_screener(spark: SparkSession, path: str) -> DataFrame:
    """Symbols trimmed and upper-cased, delisted false where absent, market cap as a number where it is one; the first row of a symbol wins.

    The order of rows is that of the file: its name and the row's place in it, which the reader gives, not a global window.
    """
    raw = spark.read.option("header", True).schema(SCREENER).csv(path).select("*", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("at"))
    return clean_screener(raw)


def clean_screener(raw: DataFrame) -> DataFrame:
    """``raw`` has the screener's columns and an order ``at``."""
    rows = raw.withColumn("symbol", F.upper(F.trim("symbol"))).where("symbol <> ''")
    kept = [c for c in rows.columns if c not in ("symbol", "at")]
    first = rows.groupBy("symbol").agg(F.min_by(F.struct(*kept), "at").alias("r"), F.min("at").alias("at"))
    flag = F.lower(F.trim(F.col("r.delisted").cast("string")))
    return first.select("symbol", F.trim("r.name").alias("name"), "r.country", "r.sector", "r.industry", F.col("r.marketCap").cast("string").try_cast("double").alias("market_cap"), F.coalesce(flag.isin("true", "1", "t", "yes", "y"), F.lit(False)).alias("delisted"), "at")


def read_tickers(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, cik) of two-column lines; the CIK is padded to ten digits."""
    parts = F.split(F.col("value"), "\t")
    return spark.read.text(path).where(F.size(parts) == 2).select(F.upper(F.trim(parts[0])).alias("symbol"), F.lpad(F.trim(parts[1]), 10, "0").alias("cik"))


def read_exchanges(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, cik, name, exchange) from a document with ``fields`` and positional ``data`` rows."""
    doc = spark.read.option("multiLine", True).schema("fields array<string>, data array<array<string>>").json(path)
    row = doc.select("fields", F.explode("data").alias("d"))
    at = lambda name: F.element_at(F.map_from_arrays("fields", "d"), name)
    return row.select(F.upper(at("ticker")).alias("symbol"), F.lpad(at("cik"), 10, "0").alias("cik"), at("name").alias("name"), at("exchange").alias("exchange"))


def merge_companies(screener: DataFrame, exchanges: DataFrame, tickers: DataFrame) -> DataFrame:
    """One row a CIK: the exchange file is preferred, the ticker file the fallback; symbols without a CIK drop out. The first
    symbol, in file order, supplies the scalars; symbols and exchanges collect in that order without repeats."""
    e = exchanges.dropDuplicates(["symbol"]).select("symbol", F.col("cik").alias("e_cik"), F.col("name").alias("e_name"), "exchange")
    t = tickers.dropDuplicates(["symbol"]).select("symbol", F.col("cik").alias("t_cik"))
    rows = screener.join(e, "symbol", "left").join(t, "symbol", "left").withColumn("cik", F.coalesce("e_cik", "t_cik")).where("cik IS NOT NULL")
    ordered = F.array_sort(F.collect_list(F.struct("at", "symbol", "exchange")))
    first = F.min_by(F.struct(F.coalesce("e_name", "name").alias("name"), "sector", "industry", "country", "market_cap", "delisted"), "at")
    out = rows.groupBy("cik").agg(first.alias("f"), ordered.alias("o"))
    listed = F.filter(F.transform("o", lambda x: x["exchange"]), lambda x: x.isNotNull())
    return out.select("cik", "f.*", F.array_distinct(F.transform("o", lambda x: x["symbol"])).alias("symbols"), F.array_distinct(listed).alias("exchanges"))


def filings_between(filings: DataFrame, start: str, end: str) -> DataFrame:
    """By report date, else filing date, inclusive; without either a filing is left out."""
    return filings.where(F.coalesce("report_date", "filing_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def newest_per(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The newest row of each group."""
    w = W.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
