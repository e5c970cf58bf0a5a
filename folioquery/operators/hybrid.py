"""Score fusion of vector and keyword legs, and reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: Relevance of a text column to a query, as a column expression.
Reranker = Callable[[str, Column], Column]


def minmax(df: DataFrame, score: str, out: str) -> DataFrame:
    """Scale to 0..1; equal scores become 1. The two extremes come from a one-row aggregate, not a window over all rows."""
    ends = df.agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"))
    scaled = F.when(F.col("__hi") == F.col("__lo"), F.lit(1.0)).otherwise((F.col(score) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")))
    return df.join(F.broadcast(ends)).withColumn(out, scaled).drop("__lo", "__hi")  # one row


def fuse(vector: DataFrame, keyword: DataFrame, key: str, k: int, alpha: float = 0.7) -> DataFrame:
    """(key, score, v, k) of the fused top k.

    ``vector`` has (key, score) with cosines, ``keyword`` (key, rank) with negative BM25; both are already limited. A missing leg
    counts 0; if a leg is empty the other has all the weight. Ties: vector order first, then keyword order.
    """
    v = minmax(vector.select(key, ((F.col("score") + 1) / 2).alias("__s"), F.col("score").alias("__raw")), "__s", "v").select(key, "v", "__raw")
    w = minmax(keyword.select(key, (-F.col("rank")).alias("__s")), "__s", "k").select(key, "k", F.col("__s").alias("__bm"))
    sizes = v.agg(F.count("*").alias("__nv")).join(F.broadcast(w.agg(F.count("*").alias("__nk"))))
    weight = F.when(F.col("__nv") == 0, F.lit(0.0)).when(F.col("__nk") == 0, F.lit(1.0)).otherwise(F.lit(float(alpha)))
    both = v.join(w, key, "full").join(F.broadcast(sizes))
    both = both.select(key, (weight * F.coalesce("v", F.lit(0.0)) + (1 - weight) * F.coalesce("k", F.lit(0.0))).alias("score"), F.coalesce("v", F.lit(0.0)).alias("v"), F.coalesce("k", F.lit(0.0)).alias("k"), "__raw", "__bm")
    order = [F.desc("score"), F.col("__raw").isNull().asc(), F.desc("__raw"), F.desc("__bm"), F.asc(key)]
    return both.orderBy(*order).limit(k).select(key, "score", "v", "k")


def lexical_relevance(query: str, text: Column) -> Column:
    """The default reranker: the share of the query's distinct tokens that the text holds."""
    wanted = sorted(set(tx.analyze(query)))
    if not wanted:
        return F.lit(0.0)
    found = F.size(F.array_intersect(tx.tokens(text), F.array(*map(F.lit, wanted))))
    return found / F.lit(float(len(wanted)))


def rerank(df: DataFrame, query: str, content: str, k: int, score: str = "score", reranker: Reranker = lexical_relevance, tie: str = "id") -> DataFrame:
    """The k most relevant rows; the old score stays as ``original_<score>``. A null text counts as empty."""
    if content not in df.columns:
        raise KeyError(content)
    if k > 1000:
        raise ValueError("at most 1000 rows can be reranked")
    out = df.withColumnRenamed(score, f"original_{score}") if score in df.columns else df
    return out.withColumn(score, reranker(query, F.coalesce(F.col(content).cast("string"), F.lit("")))).orderBy(F.desc(score), F.desc(f"original_{score}") if score in df.columns else F.lit(0), F.asc(tie)).limit(k)


def union_legs(legs: dict[str, DataFrame], k: int, score: str = "score", tie: str = "id") -> DataFrame:
    """Legs tagged by ``type``, missing columns null, best k by score."""
    out = None
    for name, leg in legs.items():
        leg = leg.withColumn("type", F.lit(name))
        out = leg if out is None else out.unionByName(leg, allowMissingColumns=True)
    return out.orderBy(F.desc(score), F.asc("type"), F.asc(tie)).limit(k)
