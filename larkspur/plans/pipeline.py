"""The assembled question-answering pipeline, for all queries in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from larkspur.functions.routing import complexity_class
from larkspur.operators.answer import extract_answers, harden, rerank
from larkspur.operators.context import fold
from larkspur.operators.dense import exact_search
from larkspur.operators.ranking import fuse, hydrate
from larkspur.operators.sparse import bm25


def hybrid_search(docs: DataFrame, queries: DataFrame, depth: int = 200, top_k: int = 50, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None) -> DataFrame:
    """BM25, with a dense leg where vectors are given, fused by reciprocal rank."""
    legs = [bm25(docs, queries, depth)]
    if vectors is not None and query_vectors is not None:
        legs.append(exact_search(vectors, query_vectors, depth))
    return fuse(legs, top_k=top_k)


def retrieve(docs: DataFrame, queries: DataFrame, depth: int = 20, top_k: int = 5, use_reranker: bool = False) -> DataFrame:
    """query_id, doc_id, text, rank: fused, hydrated, cut or reranked, and hardened."""
    found = hydrate(hybrid_search(docs, queries, depth, depth), docs)
    if use_reranker:
        found = rerank(found, queries, top_k).join(found.select("query_id", "doc_id", "text"), ["query_id", "doc_id"])
    return harden(found.filter(F.col("rank") <= top_k).select("query_id", "doc_id", "text", "rank"))


def answer(docs: DataFrame, queries: DataFrame, depth: int = 20, top_k: int = 5, use_reranker: bool = False) -> DataFrame:
    """query_id, complexity, text, citations, abstained; citations number the folded passages."""
    passages = retrieve(docs, queries, depth, top_k, use_reranker)
    passages = fold(passages.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))))
    answers = extract_answers(passages, queries)
    return answers.join(queries.select("query_id", complexity_class(F.col("query")).alias("complexity")), "query_id").select("query_id", "complexity", "text", "citations", "abstained")
