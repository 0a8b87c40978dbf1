"""Search over vectors: exact cosine, a quantised first pass, routing, caching, late interaction.

Queries meet vectors in blocks: the batch of queries is sent to every task if its
counted size allows, and is otherwise cut into batches of that size whose
rankings are put together.  A task finds each query's best k by matrix products
(``larkspur.operators.blocks``), and only those are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from larkspur.functions.backends import embed
from larkspur.functions.security import may_read
from larkspur.functions.vectors import cosine, doubles, int8, norm
from larkspur.operators.blocks import Cosine, MaxSim, best_rows
from larkspur.operators.ranking import PLACES, ranked

#: Numbers in the queries that go to every task at once, 16 MB of them.
BATCH_NUMBERS = 1 << 21
#: Numbers in the queries from which comparing a row costs far more than moving it, and rows per task then.
DEALT_NUMBERS, DEALT_ROWS = 1 << 16, 1 << 18


def _best(rows: DataFrame, queries: DataFrame, numbers: Column, kernel: type[Cosine] | type[MaxSim], k: int) -> DataFrame:
    """query_id, the columns of ``rows`` but for the last, and score: at least the best k per query (query_id, vectors).

    ``numbers`` tells how many numbers a query has.  Each task hands on the best of
    its rows; where there is much to compare, rows are dealt out to all cores.
    """
    spark = rows.sparkSession
    total = queries.agg(F.coalesce(F.sum(numbers), F.lit(0))).first()[0]
    if total >= DEALT_NUMBERS:
        rows = rows.repartition(max(spark.sparkContext.defaultParallelism, -(-rows.count() // DEALT_ROWS)))
    n = max(1, -(-total // BATCH_NUMBERS))
    part = F.pmod(F.xxhash64("query_id"), F.lit(n))
    schema = StructType([queries.schema["query_id"], *rows.schema.fields[:-1]]).add("score", "double")

    def leg(some: DataFrame) -> DataFrame:
        asked = some.toArrow().combine_chunks()  # BATCH_NUMBERS numbers
        ids, vectors = (pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in asked.columns)
        shared = spark.sparkContext.broadcast((kernel(vectors), ids))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from best_rows(batches, *shared.value, k)

        return rows.mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, [leg(queries if n == 1 else queries.filter(part == i)) for i in range(n)])


def exact_search(vectors: DataFrame, queries: DataFrame, k: int = 10, caller_groups: list[str] | None = None) -> DataFrame:
    """Cosine ranking of vectors (doc_id, vec) for queries (query_id, qvec).

    With caller_groups only rows that share a group are compared; None or an
    empty list compares all.
    """
    rows = vectors.filter(may_read(F.col("allowed_groups"), caller_groups)) if caller_groups else vectors
    rows = rows.select("doc_id", doubles(F.col("vec")).alias("vec"))
    asked = queries.select("query_id", doubles(F.col("qvec")).alias("qvec"))
    return ranked(_best(rows, asked, F.size("qvec"), Cosine, k), k)


def two_phase_search(vectors: DataFrame, queries: DataFrame, k: int = 10, oversample: int = 4) -> DataFrame:
    """A first pass over 8-bit vectors keeps k * oversample candidates; full vectors score those again."""
    small = vectors.select("doc_id", int8(doubles(F.col("vec"))).alias("vec"))
    first = exact_search(small, queries, k * oversample).select("query_id", "doc_id")
    full = first.join(vectors.select("doc_id", doubles(F.col("vec")).alias("vec")), "doc_id").join(queries.select("query_id", doubles(F.col("qvec")).alias("qvec")), "query_id")
    return ranked(full.select("query_id", "doc_id", F.round(cosine(F.col("vec"), F.col("qvec")), PLACES).alias("score")), k)


def max_sim_search(pages: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Late interaction over pages (doc_id, patches) for queries (query_id, parts)."""
    nested = "array<array<double>>"
    rows, asked = pages.select("doc_id", F.col("patches").cast(nested).alias("patches")), queries.select("query_id", F.col("parts").cast(nested).alias("parts"))
    return ranked(_best(rows, asked, F.size(F.flatten("parts")), MaxSim, k), k)


def semantic_route(routes: DataFrame, queries: DataFrame, k: int = 1) -> DataFrame:
    """query_id, label: the nearest label, or the majority of the k nearest utterances.

    ``routes`` has utt_id, label and vec.  A neighbour votes 1 and a millionth more
    per rank above the last; equal sums fall to the label that comes first.
    """
    near = exact_search(routes.withColumnRenamed("utt_id", "doc_id"), queries, max(k, 1))
    labelled = near.join(routes.select(F.col("utt_id").alias("doc_id"), "label"), "doc_id")
    size = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    votes = labelled.withColumn("vote", 1 + (size - (F.col("rank") - 1)) * F.lit(1e-6)).groupBy("query_id", "label").agg(F.round(F.sum("vote"), 9).alias("votes"), F.min("rank").alias("first"))
    return votes.groupBy("query_id").agg(F.max_by("label", F.struct("votes", -F.col("first"))).alias("label"))


class SemanticRouter:
    """Routes named by example utterances, with the backend that embeds them and the queries."""

    def __init__(self, provider: str = "hashing", k: int = 1):
        self.provider, self.k, self.routes = provider, k, None

    def add(self, utterances: DataFrame) -> "SemanticRouter":
        """Adds (utt_id, label, utterance); returns the router."""
        rows = utterances.select("utt_id", "label", embed(F.col("utterance"), self.provider).alias("vec"))
        self.routes = rows if self.routes is None else self.routes.unionByName(rows)
        return self

    def route(self, queries: DataFrame) -> DataFrame:
        """query_id, label of (query_id, query)."""
        if self.routes is None:
            raise ValueError("the router has no routes")
        return semantic_route(self.routes, queries.select("query_id", embed(F.col("query"), self.provider).alias("qvec")), self.k)


def cache_lookup(entries: DataFrame, queries: DataFrame, threshold: float = 0.85) -> DataFrame:
    """query_id, entry_id, similarity and response of the nearest entry (entry_id, vec, response); nulls below the threshold.

    Of equal similarities the earliest entry counts; zero vectors never match.
    """
    stored = entries.withColumn("vec", doubles(F.col("vec"))).filter(norm(F.col("vec")) > 0)
    asked = queries.select("query_id", doubles(F.col("qvec")).alias("qvec")).filter(norm(F.col("qvec")) > 0)
    near = _best(stored.select("entry_id", "response", "vec"), asked, F.size("qvec"), Cosine, 1).withColumnRenamed("score", "similarity")
    best = near.groupBy("query_id").agg(F.max(F.struct("similarity", (-F.col("entry_id")).alias("e"), "response")).alias("best")).filter(F.col("best.similarity") >= threshold)
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", (-F.col("best.e")).alias("entry_id"), F.col("best.similarity").alias("similarity"), F.col("best.response").alias("response"))
