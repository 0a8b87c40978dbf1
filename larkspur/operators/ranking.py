"""Order, limits and fusion of rankings: rows (query_id, doc_id, score, rank), rank from 1."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Scores are rounded before they are ranked: sums over shuffled rows differ in their last digits.
PLACES = 6


def ranked(scores: DataFrame, k: int | None = None, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Rank by falling score, then doc_id; the limit is applied before the shuffle too."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id"))
    out = scores.withColumn("rank", F.row_number().over(order).cast("int"))
    return out if k is None else out.filter(F.col("rank") <= k)


def fuse(rankings: Sequence[DataFrame], k: int = 60, top_k: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion: the sum of 1 / (k + rank) over all rankings."""
    if k <= 0:
        raise ValueError("k must be positive")
    legs = [r.select("query_id", "doc_id", "rank") for r in rankings]
    every = reduce(DataFrame.unionByName, legs)
    score = F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 9)
    return ranked(every.groupBy("query_id", "doc_id").agg(score.alias("score")), top_k)


def first_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def chunks_to_documents(ranking: DataFrame, separator: str = "::") -> DataFrame:
    """A ranking of chunks as one of documents: each document where its first chunk stands."""
    docs = ranking.withColumn("doc_id", F.substring_index("doc_id", separator, 1))
    best = docs.groupBy("query_id", "doc_id").agg(F.min("rank").alias("first"), F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy("first")
    return best.select("query_id", "doc_id", "score", F.row_number().over(w).cast("int").alias("rank"))


def hydrate(ranking: DataFrame, docs: DataFrame) -> DataFrame:
    """Rankings with the documents' texts; unknown ids are dropped."""
    return ranking.join(docs.select("doc_id", "text"), "doc_id")
