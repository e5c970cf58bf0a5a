"""Exact cosine top-k that leaves groups of vectors out.

Vectors of unit length are assigned to their nearest pivot and cut into rings by the distance to it; a (pivot, ring) is a group, a
partition of the stored table. By the triangle inequality a group's nearest and farthest distances bound the distance between a query and every vector in it, and
so the cosine, 1 - distance**2 / 2. A search scores the groups with the highest bounds, takes the k-th score found there, and reads those groups
besides whose bound reaches it; of all others no vector can be among the k best. Nothing is approximate, ties included.

Pivots come from the ``SAMPLE`` rows of the smallest hash. The directory has a row a group, at most ``PIVOTS`` times ``RINGS``, so it may go to the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Log
from . import vector

SAMPLE, PIVOTS, RINGS = 2048, 64, 32
#: Rows of a group on average, below which a table has fewer groups.
LEAST = 64
#: Rows, for each row asked for, that the first look covers.
FIRST = 8
_ZERO = -1  # the group of vectors without a direction: their cosine is 0
_PIVOT = "number int, pivot array<double>, rings int"
_GROUP = "grp int, near double, far double, n long"


def _units(batch: pa.Array, dims: int) -> np.ndarray:
    v = batch.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(batch), dims)
    size = np.sqrt(np.einsum("ij,ij->i", v, v))
    return v / np.where(size == 0, 1.0, size)[:, None]


def _centres(sample: np.ndarray, most: int) -> np.ndarray:
    """Spherical means of the sample."""
    centre = np.unique(sample, axis=0)
    centre = centre[np.linspace(0, len(centre) - 1, min(most, len(centre))).astype(int)]
    for _ in range(6):
        nearest = (sample @ centre.T).argmax(1)
        for j in np.unique(nearest):
            mean = sample[nearest == j].mean(0)
            centre[j] = mean / (np.linalg.norm(mean) or 1.0)
    return centre


class PivotIndex:
    """A stored index over (id, vector) rows. Vectors that are null, broken or of another dimension than most are no results, as in a full search."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = Log(spark, self.root)

    @property
    def exists(self) -> bool:
        return bool(self.log.live())

    def build(self, rows: DataFrame, key: str = "id", column: str = "vector") -> None:
        """Index all rows anew; running searches keep the index that they began with."""
        v = F.col(column).cast("array<float>")
        whole = rows.where(F.col(column).isNotNull() & ~vector.broken(F.col(column)) & (F.size(column) > 0)).select(F.col(key).cast("long").alias("id"), v.alias("vector"))
        sizes = whole.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
        dims, count = sizes[0] if sizes else (0, 0)
        whole = whole.where(F.size("vector") == dims)
        hashed = whole.select("vector", F.xxhash64("id", "vector").alias("h"))
        few = F.col("h") <= min(2**63 - 1, -(2**63) + int(2**64 * 4 * SAMPLE / max(1, count)))  # so that no task sends many
        drawn = hashed.where(few).orderBy("h").limit(SAMPLE).collect() or hashed.orderBy("h").limit(SAMPLE).collect()
        sample = np.array([r.vector for r in drawn], float).reshape(len(drawn), dims)
        size = np.linalg.norm(sample, axis=1)
        most = max(1, min(PIVOTS, count // (8 * LEAST)))
        rings = max(1, min(RINGS, count // (LEAST * most)))
        pivots = _centres(sample[size > 0] / size[size > 0, None], most) if (size > 0).any() else np.ones((1, dims)) / np.sqrt(max(1, dims))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    u = _units(b.column("vector"), dims)
                    cosine = u @ pivots.T
                    near = cosine.argmax(1)
                    distance = np.sqrt(np.maximum(0, ((u - pivots[near]) ** 2).sum(1)))
                    group = near * rings + np.minimum(rings - 1, (distance * rings / 2).astype(int))
                    group[~u.any(1)] = _ZERO
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(group.astype(np.int32)), pa.array(distance)], ["id", "vector", "grp", "distance"])

        keyed = whole.mapInArrow(assign, "id long, vector array<float>, grp int, distance double")
        with self.log.base() as base:
            base.number += 1  # it stands for what was there before, and is not made from it
            # a large group spans several ranges
            keyed.repartitionByRange("grp", "id").sortWithinPartitions("grp").write.partitionBy("grp").parquet(f"{base.path}/rows")
            stored = self.spark.read.schema("id long, vector array<float>, distance double, grp int").parquet(f"{base.path}/rows")
            stored.groupBy("grp").agg(F.min("distance").alias("near"), F.max("distance").alias("far"), F.count("*").alias("n")).coalesce(1).write.parquet(f"{base.path}/groups")
            self.spark.createDataFrame([(i, p.tolist(), rings) for i, p in enumerate(pivots)], _PIVOT).coalesce(1).write.parquet(f"{base.path}/pivots")

    def _part(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{self.log.live()[0]}/{name}")

    def groups(self, query: Sequence[float], k: int, ids: DataFrame | None = None) -> tuple[list[int], float]:
        """The groups that a search must read, and their share of all rows."""
        q = vector._unit(query)
        known = self._part("pivots", _PIVOT).orderBy("number").collect()
        pivots = np.array([r.pivot for r in known])
        held = self._part("groups", _GROUP).collect()
        if not held or pivots.shape[1] != len(q):
            return [], 0.0
        group, near, far, n = (np.array([r[i] for r in held]) for i in range(4))
        d = np.linalg.norm(pivots - q, axis=1)[np.maximum(group, 0) // known[0].rings]
        least = np.maximum(0, np.maximum(near - d, d - far) - 1e-6)
        bound = np.where(group == _ZERO, 0.0, 1 - least**2 / 2) + 1e-6
        if not q.any():
            bound[:] = 1e-6  # every cosine is 0
        order = np.argsort(-bound, kind="stable")
        seen, wanted = np.cumsum(n[order]), FIRST * k
        while True:
            first = order[: int(np.searchsorted(seen, wanted)) + 1]
            if len(first) == len(order):
                return group.tolist(), 1.0
            scores = [r.score for r in self._search(query, k, ids, group[first].tolist()).collect()]  # k rows
            if len(scores) == k:
                break
            wanted *= 8
        chosen = np.union1d(np.flatnonzero(bound >= scores[-1]), first)
        return group[chosen].tolist(), float(n[chosen].sum() / n.sum())

    def _search(self, query: Sequence[float], k: int, ids: DataFrame | None, groups: list[int]) -> DataFrame:
        rows = self._part("rows", "id long, vector array<float>, grp int").where(F.col("grp").isin(groups)).select("id", "vector")
        return vector.top_k(rows if ids is None else rows.join(ids.select("id"), "id", "left_semi"), "id", "vector", query, k)

    def search(self, query: Sequence[float], k: int, ids: DataFrame | None = None) -> DataFrame:
        """(id, score) of the k most similar rows, best first, ties by id; of ``ids`` alone, where they are given."""
        return self._search(query, k, ids, self.groups(query, k, ids)[0])
