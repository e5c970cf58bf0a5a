"""Token counts as delta-maintained rollups.

A rollup store is a folder of committed batches. Each batch holds signed changes: per (source, lang,
tokenizer) the sums of documents and tokens it adds or takes away, and per (doc_id, tokenizer) the
state it leaves. Totals are the sum of all committed batches' rollups: additive, and never recounted from text.

A batch is staged under a name of its own and committed by one exclusive rename to the next sequence number, so of two writers one gets
a WriteConflict; numbers are not used again, whatever is compacted meanwhile (``storage.Log``). A batch id that is there already is done: committing it again changes nothing, whatever happened to the first
attempt's writer. ``compact`` folds committed batches into one and keeps their ids. The newest state of a document decides what a
delete or a revised count takes away, so both need only the ids, and a commit groups the states of its own documents alone.

Counting is partial before each shuffle, so a source that holds a third of all rows costs one row a task.

Defined cases: a null or empty text counts zero tokens and one document; null source or lang are groups of
their own; a null doc_id cannot be addressed later, so such rows are added as they are and never revised.
Within a batch, several changes to one (doc_id, tokenizer) collapse to one: a delete wins over
an upsert, then the larger count; so repeated rows count once. Deleting an unknown document changes nothing.
An empty batch commits and changes nothing. Other input columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Log, Writing
from . import kit

#: Token counters by version: built-in expressions over a text column.
COUNTERS = {
    "words-1": lambda text: F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")),
    "alnum-2": lambda text: F.regexp_count(text, F.lit("[\\p{L}\\p{N}]+")),
}
STATE = "doc_id long, tokenizer string, source string, lang string, tokens long, live boolean, seq long"
STATE_COLUMNS = ("doc_id", "tokenizer", "source", "lang", "tokens", "live", "seq")
CHANGE = "doc_id long, tokenizer string, source string, lang string, tokens long, live boolean"
IDS = "batch_id string, seq long"
DELTA = "source string, lang string, tokenizer string, d_documents long, d_tokens long"
KEYS = ("source", "lang", "tokenizer")


def counts(docs: DataFrame, version: str, counter: Column | None = None) -> DataFrame:
    """Upserts (doc_id, tokenizer, source, lang, tokens) of every row's whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    number = counter if counter is not None else COUNTERS[version](text)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(version).alias("tokenizer"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), number.cast("long").alias("tokens"))


class RollupStore:
    """Committed batches under ``root``: folders named by their sequence number, each with the batch ids it stands for, its rollup and its states.

    A folder that ``compact`` made ends in ``-base`` and stands for all up to its number.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or f"{kit.shared_dir(spark)}/token-rollup-{uuid.uuid4().hex}"
        self.folder = Log(spark, self.root)
        self.folder.create()

    def _live(self) -> list[str]:
        """Folders to read: the newest base and what came after it."""
        return self.folder.live()

    def _read(self, part: str, schema: str, live: list[str] | None = None) -> DataFrame:
        live = self._live() if live is None else live
        if not live:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{n}/{part}" for n in live])

    def committed(self) -> DataFrame:
        """(batch_id, seq) of all committed batches."""
        return self._read("ids", IDS)

    def state(self, ids: DataFrame | None = None, live: list[str] | None = None) -> DataFrame:
        """The newest state of each (doc_id, tokenizer); of the documents in ``ids`` (doc_id) alone, nothing else is grouped."""
        rows = self._read("state", STATE, live)
        rows = rows if ids is None else rows.join(ids, "doc_id", "left_semi")
        newest = rows.groupBy("doc_id", "tokenizer").agg(F.max_by(F.struct("source", "lang", "tokens", "live", "seq"), "seq").alias("s"))
        return newest.select("doc_id", "tokenizer", "s.*")

    def commit(self, batch_id: str, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> bool:
        """Apply inserts, revised counts and deletes (doc_id[, tokenizer]); False if the id was committed before.

        Where another writer commits meanwhile, WriteConflict is raised and nothing is left: what this batch takes away was computed
        from states that are no longer the newest.
        """
        if not batch_id:
            raise ValueError("a batch id is a non-empty name")
        with self.folder.part() as part:
            done = bool(part.live) and bool(self._read("ids", IDS, part.live).where(F.col("batch_id") == batch_id).limit(1).count())
            if not done:
                self._write(part, batch_id, upserts, deletes)
            part.wanted = not done
        return not done

    def _write(self, part: Writing, batch_id: str, upserts: DataFrame | None, deletes: DataFrame | None) -> None:
        at, seq = part.path, part.number
        self.spark.createDataFrame([(batch_id, seq)], IDS).coalesce(1).write.parquet(f"{at}/ids")
        columns = ["doc_id", "tokenizer", "source", "lang", "tokens"]
        changes = self.spark.createDataFrame([], CHANGE)
        if upserts is not None:  # counted once: the ids and the changes are both read from here
            upserts.select(*columns, F.lit(True).alias("live")).write.parquet(f"{at}/changes")
            changes = self.spark.read.schema(CHANGE).parquet(f"{at}/changes")
        lost = changes.where("doc_id IS NULL")
        changes = changes.where("doc_id IS NOT NULL")
        touched = changes.select("doc_id")
        if deletes is not None:
            ids = deletes.where("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id").cast("long"))
            touched = touched.unionByName(ids.select("doc_id"))
        old = self.state(touched, part.live)
        if deletes is not None:
            if "tokenizer" not in deletes.columns:
                ids = ids.select("doc_id").distinct().join(old.select("doc_id", "tokenizer"), "doc_id")
            gone = ids.select("doc_id", "tokenizer", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang"), F.lit(0).cast("long").alias("tokens"), F.lit(False).alias("live"))
            changes = changes.unionByName(gone)
        best = F.max_by(F.struct("source", "lang", "tokens", "live"), F.struct(~F.col("live"), "tokens", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))))
        changes = changes.groupBy("doc_id", "tokenizer").agg(best.alias("s")).select("doc_id", "tokenizer", "s.*")
        o = old.select("doc_id", "tokenizer", *[F.col(c).alias(f"o_{c}") for c in ("source", "lang", "tokens", "live")])
        both = changes.join(o, ["doc_id", "tokenizer"], "left")
        both = both.where("live OR coalesce(o_live, false)")
        both.withColumn("seq", F.lit(seq).cast("long")).write.parquet(f"{at}/joined")
        joined = self.spark.read.parquet(f"{at}/joined")
        added = joined.where("live").select(*KEYS, F.lit(1).alias("d"), F.col("tokens").alias("t"))
        taken = joined.where("o_live").select(F.col("o_source").alias("source"), F.col("o_lang").alias("lang"), "tokenizer", F.lit(-1).alias("d"), (-F.col("o_tokens")).alias("t"))
        loose = lost.select(*KEYS, F.lit(1).alias("d"), F.col("tokens").alias("t"))
        delta = added.unionByName(taken).unionByName(loose).groupBy(*KEYS).agg(F.sum("d").cast("long").alias("d_documents"), F.sum("t").cast("long").alias("d_tokens"))
        delta.write.parquet(f"{at}/delta")
        joined.select(*STATE_COLUMNS).write.parquet(f"{at}/state")
        for name in ("joined", "changes"):
            self.folder.delete(f"{at.rpartition('/')[2]}/{name}")

    def compact(self) -> None:
        """Fold all committed batches into one folder, with their ids as a table; until its rename the old ones count, and afterwards it alone."""
        if len(self._live()) < 2:
            return
        with self.folder.base() as base:
            at, live = base.path, base.live
            self._read("ids", IDS, live).coalesce(1).write.parquet(f"{at}/ids")  # a short row a batch
            self.totals(False, live).select(*KEYS, F.col("documents").alias("d_documents"), F.col("tokens").alias("d_tokens")).write.parquet(f"{at}/delta")
            self.state(live=live).select(*STATE_COLUMNS).write.parquet(f"{at}/state")

    def totals(self, present: bool = True, live: list[str] | None = None) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens); with ``present``, only groups that have documents."""
        out = self._read("delta", DELTA, live).groupBy(*KEYS).agg(F.sum("d_documents").alias("documents"), F.sum("d_tokens").alias("tokens"))
        return out.where("documents <> 0") if present else out
