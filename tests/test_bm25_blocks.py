"""BM25 by blocks against the joins that give all scores, and what it gathers."""

import random

import pytest

from larkspur.operators import blocks, context as C, sparse
from larkspur.operators.ranking import ranked


def rows_of(df):
    return sorted(tuple(str(x) for x in r) for r in df.collect())


@pytest.mark.parametrize("repeat", [False, True])
@pytest.mark.parametrize("k", [1, 4, 300])
def test_best_are_those_of_all_scores(spark, monkeypatch, repeat, k):
    monkeypatch.setattr(blocks, "PRODUCTS", 200)
    monkeypatch.setattr(sparse, "BATCH_TERMS", 40)
    rng = random.Random(k)
    text = lambda n: " ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 2) for _ in range(n))
    docs = [(f"d{i}", text(rng.randint(0, 12))) for i in range(150)] + [("n", None), ("e", "")]
    docs += [("d3", docs[3][1]), ("d4", text(5)), ("n", None), (None, "a b c")] * 2 if repeat else [(None, "a b c")]
    asked = [(i, text(6)) for i in range(20)] + [(None, "a b"), (3, "b c"), (50, None), (51, "zzz")]
    d, q = spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(asked, "query_id int, query string")
    every = sparse.bm25(d, q, None).select("query_id", "doc_id", "score")
    assert rows_of(sparse.bm25(d, q, k)) == rows_of(ranked(every, k))


def test_terms_are_not_gathered(spark):
    """Plans of rankings deal out no documents' terms."""
    docs = spark.range(100).selectExpr("id as doc_id", "'a b c' as text")
    plan = sparse.bm25(docs, spark.createDataFrame([(1, "a")], "query_id int, query string"), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "LogicalRDD [term" not in plan


def test_children_and_parents_without_hits_stay(spark):
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "x", 3), (2, "b", 1)], "query_id int, doc_id string, rank int")
    children = spark.createDataFrame([("a", 10, 0), ("a", 11, 1), ("b", 10, 0), ("c", 12, 0)], "child_id string, parent_id long, ord int")
    parents = spark.createDataFrame([(10, "p"), (11, "q"), (12, "r")], "parent_id long, text string")
    got = sorted(tuple(r) for r in C.expand_to_parents(hits, children, parents).collect())
    assert got == [(1, 10, "p", 2), (1, 11, "q", 1), (2, 10, "p", 1)]
