"""Readers of corpora, golden sets and files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.functions.html import parse, sniff_bytes
from larkspur.schema import CORPUS, GOLDEN

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def corpus_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """id, title, text; blank lines are skipped."""
    return spark.read.schema(CORPUS).json(path)


def golden_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """query_id, query, relevant, gains, reference_answer: an item per line, ids by the query's hash."""
    rows = spark.read.schema(GOLDEN).json(path).filter("query is not null")
    return rows.select(F.xxhash64("query").alias("query_id"), "query", F.array_distinct(F.coalesce("relevant", F.array().cast("array<string>"))).alias("relevant"), "gains", "reference_answer")


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, content_type, text of whole files; PDF files come without text unless a parser is registered."""
    rows = spark.read.format("binaryFile").load(path).select("path", "content", sniff_bytes(F.col("content")).alias("content_type"))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return rows.select("path", "content_type", F.when(F.col("content_type") != "application/pdf", parse(text, F.col("content_type"))).alias("text"))


def parse_with(rows: DataFrame, content_type: str) -> DataFrame:
    """Fills the text of one content type by its registered parser (path, content, content_type, text)."""
    from larkspur.registry import backends

    parser = backends.get("parser", content_type)

    @F.pandas_udf("string")
    def run(content: pd.Series) -> pd.Series:
        return parser(content)

    return rows.withColumn("text", F.when(F.col("content_type") == content_type, run("content")).otherwise(F.col("text")))


def count_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, n: lines that aren't blank per sample file."""
    rows = spark.read.text(paths).withColumn("path", F.input_file_name())
    return rows.filter(F.trim("value") != "").groupBy("path").agg(F.count(F.lit(1)).alias("n"))
