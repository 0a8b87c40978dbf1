"""Evaluation suites: body against body and title, and a sweep over chunk sizes.

``python -m larkspur.plans.suite CORPUS.jsonl GOLDEN.jsonl [--k 5]`` prints the scorecards.
"""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from larkspur.frames import cut, small_batches
from larkspur.functions.text import atoms, tokens
from larkspur.operators.chunking import chunk_documents, chunk_terms
from larkspur.operators.metrics import compare, scorecard
from larkspur.operators.ranking import chunks_to_documents, fuse
from larkspur.operators.sparse import bm25, rankings


def body_and_title(corpus: DataFrame, golden: DataFrame, k: int = 5, depth: int = 10) -> DataFrame:
    """Scorecards of BM25 over the text and of its fusion with BM25 over the title (id, title, text)."""
    body = bm25(corpus.select(F.col("id").alias("doc_id"), "text"), golden, depth)
    title = bm25(corpus.select(F.col("id").alias("doc_id"), F.col("title").alias("text")), golden, depth)
    return compare({"body": body, "body+title": fuse([body, title], top_k=depth)}, golden, k)


def chunk_sweep(docs: DataFrame, golden: DataFrame, sizes: tuple[int, ...] = (15, 40, 120), overlap: int = 0, k: int = 5, depth: int = 20) -> DataFrame:
    """A scorecard per chunk size (name: the size), documents standing where their best chunk does.

    Chunk ids repeat only where ids of documents do.  Where they don't, all sizes share
    one reading of the documents for totals and one for scores, and no chunk is shuffled.
    """
    if docs.groupBy(F.col("doc_id").cast("string")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        rows = small_batches(docs).select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(atoms(F.col("text")), F.array().cast("array<string>")).alias("atoms"))
        rows = rows.select("doc_id", "atoms", F.transform("atoms", tokens).alias("tokens"))
        found = cut(rankings(rows, golden, len(sizes), lambda batch, terms: chunk_terms(batch, terms, sizes, overlap), depth))
        legs = [found.filter(F.col("leg") == i).drop("leg") for i in range(len(sizes))]
    else:
        legs = [bm25(chunk_documents(docs, size, overlap).select(F.col("id").alias("doc_id"), "text"), golden, depth) for size in sizes]
    cards = [scorecard(str(size), chunks_to_documents(leg), golden, k) for size, leg in zip(sizes, legs)]
    return reduce(DataFrame.unionByName, cards)


def main() -> None:
    from larkspur.session import local_session
    from larkspur.sources.readers import corpus_jsonl, golden_jsonl

    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("corpus")
    args.add_argument("golden")
    args.add_argument("--k", type=int, default=5)
    given = args.parse_args()
    spark = local_session()
    body_and_title(corpus_jsonl(spark, given.corpus), golden_jsonl(spark, given.golden), given.k).show()


if __name__ == "__main__":
    main()
