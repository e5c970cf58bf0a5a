"""Connected components over an edge table, by alternating large-star and small-star steps.

Each step is a group-by and a join on edges; every round is written to the shared folder, so nothing is
recomputed after a lost executor and no link ever reaches the driver. Where the measured number of edges is within ``few``
(16 bytes each), the rounds are not worth their shuffles: one executor task joins the sets in memory. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge, and it leads to a node that has none: then all edges are stars around smallest nodes."""
    many = edges.groupBy("u").count().where("count > 1").select("u")
    chained = edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi")
    return not many.unionByName(chained).limit(1).count()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of all nodes but the smallest ones, by label merging and pointer jumping."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            break
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]
    moved = label != np.arange(len(ids))
    return ids[moved], ids[label[moved]]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(kit.ints(b.column(0), 0), kit.ints(b.column(1), 0)) for b in batches]
        if got:
            u, v = (np.concatenate(x) for x in zip(*got, strict=True))
            node, low = smallest_reachable(u, v)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(low)], ["node", "component"])

    return edges.select("u", "v").repartition(1).transform(kit.mapping, join, "node long, component long")


def connected_components(edges: DataFrame, few: int = 2_000_000, rounds: int = 60) -> DataFrame:
    """Rows (node, component): the smallest node reachable, for every node with an edge that is not the smallest itself.

    ``edges`` has two long columns; direction, repeats, loops and nulls do not matter.
    """
    a, b = (F.col(c).cast("long") for c in edges.columns[:2])
    now = kit.written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges")
    if now.count() <= few:
        return kit.written(_in_one_task(now), "components")
    for _ in range(rounds):
        if _settled(now):
            break
        now = kit.written(_small_star(_large_star(now)), "edges")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
