"""Positions over a whole table without a task that orders all rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import shared_dir


def with_position(rows: DataFrame, *order: Column) -> DataFrame:
    """All columns, ``position`` from 0 in the order given, and ``total``.

    The rows are written once in ranges, each with its range's number: numbers taken again from a second run of the range shuffle could be
    others. Positions then follow from the rows before each range.
    """
    spark = rows.sparkSession
    at = f"{shared_dir(spark)}/ranges-{uuid.uuid4().hex}"
    rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).write.parquet(at)
    kept = spark.read.parquet(at)
    sizes = kept.groupBy("__part").agg(F.count("*").alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__at"), F.sum("__n").over(W.partitionBy()).alias("total"))
    local = kept.withColumn("__r", F.row_number().over(W.partitionBy("__part").orderBy(*order)))
    ranked = local.join(F.broadcast(starts), "__part")  # one row a range
    return ranked.withColumn("position", F.col("__at") + F.col("__r") - 1).drop("__part", "__at", "__r")
