"""Incremental ingest: file streams with availableNow, upserted by foreachBatch; error isolation and counts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.writes import MergeTable, newest_by
from ..storage import Log, shared_dir
from . import flows


def incremental_upsert(spark: SparkSession, like: DataFrame, path: str, key: str, newest: list[str], table: MergeTable | None = None, checkpoint: str | None = None) -> DataFrame:
    """Read new files at ``path`` once each and upsert the newest row of every key; returns the table.

    The checkpoint remembers what was read, so a second run with the same checkpoint sees only new files. A micro-batch writes its own rows
    and never the whole table; one that is replayed after a failure changes nothing, as the newest row wins again.
    """
    root = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    table = table or MergeTable(spark, f"{root}/table", like, key, newest)
    stream = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 64)
    # a single file is read through its folder and a name filter
    folder, _, name = path.rpartition("/")
    source = stream.option("pathGlobFilter", name).option("recursiveFileLookup", "false").parquet(folder) if not _is_folder(spark, path) else stream.parquet(path)
    run = source.writeStream.foreachBatch(lambda batch, _: table.append(batch)).option("checkpointLocation", checkpoint or f"{root}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return table.read()


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def unsynced(listed: DataFrame, synced: DataFrame, key: str = "accession_number") -> DataFrame:
    """What a source lists and no earlier run has finished."""
    return listed.join(synced.select(key).distinct(), key, "left_anti")


def isolate(rows: DataFrame, check: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good, bad with ``_error``): rows that fail a check leave without stopping the others."""
    error = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in check.items()])
    marked = rows.withColumn("_error", error)
    return marked.where("_error IS NULL").drop("_error"), marked.where("_error IS NOT NULL")


def counts_by_parent(children: DataFrame, parent: str, name: str) -> DataFrame:
    """How many children each parent has; written last, so it tells a finished ingest."""
    return children.groupBy(parent).agg(F.count("*").alias(name))


def quarters_complete(available: DataFrame, synced: DataFrame) -> DataFrame:
    """Per company, whether every quarter a source has (1..4) is synced (Q1..Q4)."""
    want = available.groupBy("company_id", "fiscal_year").agg(F.collect_set(F.concat(F.lit("Q"), F.col("quarter").cast("string"))).alias("want"))
    have = synced.groupBy("company_id", "fiscal_year").agg(F.collect_set("fiscal_period").alias("have"))
    met = want.join(have, ["company_id", "fiscal_year"], "left")
    return met.select("company_id", "fiscal_year", (F.size(F.array_except("want", F.coalesce("have", F.array().cast("array<string>")))) == 0).alias("complete"))


def windowed_counts(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Event-time tumbling counts with a watermark; works on a stream and on a batch."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def replay(outbox: DataFrame, embed: Callable[[DataFrame], DataFrame], keys: Iterable[str] = ("table_name", "column_name", "row_id", "text_sha256")) -> tuple[DataFrame, DataFrame]:
    """(embedded rows, what stays in the outbox) after one retry."""
    done = embed(outbox).where("vector IS NOT NULL")
    return done, outbox.join(done.select(*keys), list(keys), "left_anti")


#: What identifies a row of each table, in the order in which tables are written: a filing counts as synced once all else is there.
INGESTED = {
    "filing_pages": ("filing_id", "page"),
    "filing_section_pages": ("filing_id", "section", "page"),
    "filing_section_chunks": ("filing_id", "section", "index"),
    "filing_errors": ("filing_id", "step"),
    "filings": ("filing_id",),
}


class FilingIngest:
    """Filings from a source to tables, restartable at any point.

    A micro-batch leaves out what is synced already, parses the rest once, and appends to one table after the other, ``filings`` last. Rows
    have keys, and of equal keys one counts; so a batch that died between two tables is written again by the next run, and no row is lost or doubled. A filing
    that failed has its errors as rows, is not synced, and is taken up again when its source lists it anew.
    """

    def __init__(self, spark: SparkSession, root: str, companies: DataFrame):
        self.spark, self.root, self.companies = spark, root.rstrip("/"), companies

    def table(self, name: str, like: DataFrame | None = None) -> MergeTable | None:
        """A table by its name; None before its first row where no frame tells its columns."""
        at = f"{self.root}/{name}"
        if like is None:
            names = Log(self.spark, at).live()
            if not names:
                return None
            like = self.spark.read.parquet(*[f"{at}/{n}" for n in names[:1]])
        return MergeTable(self.spark, at, like, "__key", ["__batch"])

    def read(self, name: str) -> DataFrame | None:
        table = self.table(name)
        return None if table is None else table.read().drop("__key", "__batch")

    def apply(self, batch: DataFrame, number: int) -> None:
        """Write one micro-batch; writing it again changes nothing."""
        at = f"{self.root}/_work/{number}-{uuid.uuid4().hex}"

        def stage(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{at}/{name}")
            return self.spark.read.schema(df.schema).parquet(f"{at}/{name}")

        known = batch.where("filing_id IS NOT NULL").dropDuplicates(["filing_id"])
        done = self.read("filings")
        fresh = stage(known if done is None else unsynced(known, done.where("synced"), "filing_id"), "batch")
        for name, df in flows.process(fresh, self.companies, stage).items():
            key = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in INGESTED[name]])
            rows = df.withColumn("__key", key).withColumn("__batch", F.lit(number).cast("long"))
            self.table(name, rows).append(rows)
        Log(self.spark, f"{self.root}/_work").delete(at.rpartition("/")[2])

    def run(self, stream: DataFrame, checkpoint: str | None = None) -> None:
        """Take all that the stream has; a second run with the same checkpoint takes only what is new."""
        query = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint or f"{self.root}/_checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
