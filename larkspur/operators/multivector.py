"""Pages as several vectors: indexing through a backend, and pooling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from larkspur.operators.hierarchy import greedy_groups
from larkspur.registry import backends


def pooled(patches: Column, factor: int = 3) -> Column:
    """Patches in greedy clusters of ``factor`` similar ones, each replaced by its mean."""

    @F.pandas_udf("array<array<double>>")
    def run(pages: pd.Series) -> pd.Series:
        out = []
        for page in pages:
            if page is None or not len(page):
                out.append([])
                continue
            vectors = np.stack([np.asarray(v, float) for v in page])
            groups = np.array(greedy_groups(vectors, factor))
            out.append([vectors[groups == g].mean(axis=0).tolist() for g in range(groups.max() + 1)])
        return pd.Series(out)

    return run(patches)


def index_pages(pages: DataFrame, backbone: str, factor: int = 1) -> DataFrame:
    """doc_id, patches of (doc_id, image) by a registered page encoder (component ``page``)."""
    encoder = backends.get("page", backbone)

    @F.pandas_udf("array<array<double>>")
    def encode(images: pd.Series) -> pd.Series:
        return encoder(images)

    rows = pages.select("doc_id", encode("image").alias("patches"))
    return rows if factor <= 1 else rows.withColumn("patches", pooled(F.col("patches"), factor))
