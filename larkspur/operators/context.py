"""Assembling the context of a query from its ranked passages (query_id, doc_id, text, rank)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from larkspur.frames import cut, join_small
from larkspur.functions.text import word_count


def folded_position(rank: Column, n: Column) -> Column:
    """0-based place that puts the best passages at both ends: ranks 1, 3, 5, 4, 2 for five."""
    r = rank - 1
    return F.when(r % 2 == 0, F.floor(r / 2)).otherwise(n - 1 - F.floor((r - 1) / 2)).cast("int")


def fold(passages: DataFrame) -> DataFrame:
    """Adds position."""
    return passages.withColumn("position", folded_position(F.col("rank"), F.count(F.lit(1)).over(Window.partitionBy("query_id"))))


def within_budget(passages: DataFrame, budget: int) -> DataFrame:
    """Passages up to the first that overflows the budget of words; the first one always stays.

    Counts aren't negative, so the running sum tells all.
    """
    running = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return passages.withColumn("words", word_count(F.col("text")).cast("long")).withColumn("used", F.sum("words").over(running)).filter((F.col("used") <= budget) | (F.col("rank") == 1))


def build_context(passages: DataFrame, budget: int) -> DataFrame:
    """query_id, n_passages, context: budget, fold, join by blank lines."""
    kept = within_budget(passages, budget)
    w = Window.partitionBy("query_id").orderBy("rank")
    kept = fold(kept.withColumn("rank", F.row_number().over(w)))
    parts = F.array_sort(F.collect_list(F.struct("position", "text")))
    return kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_passages"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("context"))


def diversify(candidates: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
    """query_id, doc_id, pick: maximal marginal relevance over a shortlist (query_id, doc_id, rank, vec, qvec).

    Greedy: weight * similarity to the query - (1 - weight) * largest similarity
    to what is chosen; ties fall to the better rank.  A shortlist is bounded by
    the depth of its ranking.
    """

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank", kind="stable")
        vecs = np.stack([np.asarray(v, float) for v in group["vec"]])
        query = np.asarray(group["qvec"].iloc[0], float)
        unit = vecs / np.maximum(np.linalg.norm(vecs, axis=1, keepdims=True), 1e-300)
        relevance = unit @ (query / max(np.linalg.norm(query), 1e-300))
        worst = np.full(len(group), -np.inf)
        free = np.ones(len(group), bool)
        picks: list[int] = []
        while free.any() and len(picks) < k:
            gain = weight * relevance - (1 - weight) * (worst if picks else 0.0)
            best = int(np.argmax(np.where(free, np.round(gain, 12), -np.inf)))
            picks.append(best)
            free[best] = False
            worst = np.maximum(worst, unit @ unit[best])
        chosen = group.iloc[picks]
        return pd.DataFrame({"query_id": chosen["query_id"].to_numpy(), "doc_id": chosen["doc_id"].to_numpy(), "pick": np.arange(1, len(picks) + 1, dtype=np.int32)})

    ids = candidates.select("query_id", "doc_id").schema
    return candidates.groupBy("query_id").applyInPandas(choose, ids.add("pick", "integer"))


def expand_to_parents(hits: DataFrame, children: DataFrame, parents: DataFrame) -> DataFrame:
    """query_id, parent_id, text, position: parents of the ranked children, each once, in order of first hit.

    Unknown children are skipped; of a child that was added twice the last parent
    (by ord) counts.  Children and parents that no hit names stay where they are.
    """
    hits = cut(hits.select("query_id", F.col("doc_id").alias("child_id"), "rank"))
    children = join_small(children, hits.select("child_id").distinct(), "child_id", "left_semi")
    last = children.groupBy("child_id").agg(F.max_by("parent_id", "ord").alias("parent_id"))
    first = hits.join(last, "child_id").groupBy("query_id", "parent_id").agg(F.min("rank").alias("first"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("first")).cast("int")
    return join_small(parents.select("parent_id", "text"), cut(first), "parent_id").select("query_id", "parent_id", "text", place.alias("position"))
