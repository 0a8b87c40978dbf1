"""Summary trees: greedy clusters, a summary per cluster, and search over all layers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from larkspur.frames import cut
from larkspur.operators.dense import exact_search


def greedy_groups(vectors: np.ndarray, size: int) -> list[int]:
    """Group number per row: seeds in order, each with its nearest unused rows; ties to the earlier."""
    lengths = np.linalg.norm(vectors, axis=1)
    unit = vectors / np.where(lengths > 0, lengths, 1.0)[:, None]
    group = np.full(len(vectors), -1)
    number = 0
    for seed in range(len(vectors)):
        if group[seed] >= 0:
            continue
        group[seed] = number
        free = np.flatnonzero(group < 0)
        near = free[np.argsort(-np.round(unit[free] @ unit[seed], 12), kind="stable")[: max(0, size - 1)]]
        group[near] = number
        number += 1
    return group.tolist()


def cluster(nodes: DataFrame, size: int, by: str = "tree_id") -> DataFrame:
    """node_id and group of (tree_id, node_id, vec), per tree in the order of node_id; a tree is clustered as a whole."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node_id", kind="stable")
        return pd.DataFrame({by: part[by], "node_id": part["node_id"], "group": greedy_groups(np.stack([np.asarray(v, float) for v in part["vec"]]), size)})

    return nodes.select(by, "node_id", "vec").groupBy(by).applyInPandas(run, nodes.select(by, "node_id").schema.add("group", "integer"))


def build_tree(leaves: DataFrame, embed: Callable[[DataFrame], DataFrame], summarize: Callable[[DataFrame], DataFrame], size: int = 4, max_layers: int = 3) -> DataFrame:
    """tree_id, node_id, text, layer, vec of all layers above and including ``leaves`` (tree_id, node_id, text).

    embed adds vec; summarize makes (tree_id, node_id, text) of (tree_id, group,
    text), the group's texts joined by blank lines.  A tree grows until it has one
    node, no longer shrinks, or has max_layers layers of summaries.
    """
    layer = embed(leaves.withColumn("layer", F.lit(0)))
    out = layer
    for number in range(1, max_layers + 1):
        sizes = layer.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("tree_id", "n")
        grown = layer.join(sizes, "tree_id")
        if grown.isEmpty():
            break
        groups = cluster(grown, size)
        fewer = groups.groupBy("tree_id").agg((F.max("group") + 1).alias("groups")).join(sizes, "tree_id").filter("groups < n").select("tree_id")
        joined = grown.join(groups, ["tree_id", "node_id"]).join(fewer, "tree_id")
        parts = F.array_sort(F.collect_list(F.struct("node_id", "text")))
        texts = joined.groupBy("tree_id", "group").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"))
        layer = embed(summarize(texts).withColumn("layer", F.lit(number)))
        layer = cut(layer)
        out = out.unionByName(layer)
    return out


def first_sentence(texts: DataFrame) -> DataFrame:
    """Offline summaries: the first sentence of each text of a group."""
    first = F.transform(F.split("text", "\n\n"), lambda t: F.regexp_extract(t, r"(?s)^(.*?[.!?])(?:\s|$)|^(.*)$", 0))
    return texts.select("tree_id", F.concat_ws(":", F.lit("group"), F.col("group").cast("string")).alias("node_id"), F.array_join(first, " ").alias("text"))


def collapsed_search(nodes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Cosine ranking over the nodes of all layers (node_id, layer, vec)."""
    return exact_search(nodes.select(F.col("node_id").alias("doc_id"), "vec"), queries, k)
