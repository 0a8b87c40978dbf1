"""A semantic cache kept as files: entries are appended, lookups take the nearest."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.functions.backends import embed
from larkspur.operators.dense import cache_lookup

_ENTRY = "entry_id long, query string, response string, vec array<double>"


class SemanticCache:
    """Responses by the similarity of their queries; entries never expire and are never evicted."""

    def __init__(self, spark: SparkSession, path: str, threshold: float = 0.85, provider: str = "hashing"):
        self.spark, self.path, self.threshold, self.provider = spark, path, threshold, provider

    def entries(self) -> DataFrame:
        try:
            return self.spark.read.schema(_ENTRY).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], _ENTRY)

    def put(self, answers: DataFrame) -> None:
        """Append (entry_id, query, response); of equally near entries the smallest entry_id answers."""
        rows = answers.select(F.col("entry_id").cast("long").alias("entry_id"), "query", "response", embed(F.col("query"), self.provider).alias("vec"))
        rows.write.mode("append").parquet(self.path)

    def get(self, queries: DataFrame) -> DataFrame:
        """query_id, entry_id, similarity, response of (query_id, query); nulls where nothing is near enough."""
        asked = queries.select("query_id", embed(F.col("query"), self.provider).alias("qvec"))
        return cache_lookup(self.entries(), asked, self.threshold)
