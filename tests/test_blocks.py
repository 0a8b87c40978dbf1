"""Searches by blocks against the expressions for all pairs, on odd vectors too."""

import random
import time
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions import vectors as V
from larkspur.operators import blocks, dense as D
from larkspur.operators.ranking import ranked

NAN, INF = float("nan"), float("inf")


def odd_vectors(rng, n):
    special = [None, [], [0.0, 0.0, 0.0], [None, 1.0, 0.0], [1.0, 0.0], [NAN, 0.0, 1.0], [INF, 0.0, 1.0], [1e-200, 0.0, 0.0], [1.0, 0.0078125, 0.0], [1e200, 1e200, 0.0]]
    return special + [[float(rng.randint(-3, 3)) for _ in range(3)] for _ in range(n)]


def rows_of(df):
    return sorted(tuple(str(x) for x in r) for r in df.collect())


def small(monkeypatch):
    monkeypatch.setattr(D, "DEALT_NUMBERS", 1)
    monkeypatch.setattr(D, "DEALT_ROWS", 40)
    monkeypatch.setattr(blocks, "PRODUCTS", 300)
    monkeypatch.setattr(blocks, "PAIRS", 50)


@pytest.mark.parametrize("k", [1, 3, 500])
@pytest.mark.parametrize("odd", [True, False])
def test_cosine_is_the_expression(spark, monkeypatch, k, odd):
    small(monkeypatch)
    monkeypatch.setattr(D, "BATCH_NUMBERS", 60)
    rng = random.Random(k)
    made = odd_vectors(rng, 120)[0 if odd else 10 :]
    v = spark.createDataFrame([(str(i) if i else None, x) for i, x in enumerate(made)], "doc_id string, vec array<double>")
    q = spark.createDataFrame([(i, x) for i, x in enumerate(odd_vectors(rng, 40)[0 if odd else 10 :])], "query_id int, qvec array<double>")
    want = ranked(v.crossJoin(q).select("query_id", "doc_id", F.round(V.cosine(F.col("vec"), F.col("qvec")), 6).alias("score")), k)
    assert rows_of(D.exact_search(v, q, k)) == rows_of(want)


@pytest.mark.parametrize("k", [1, 4])
@pytest.mark.parametrize("odd", [True, False])
def test_max_sim_is_the_expression(spark, monkeypatch, k, odd):
    small(monkeypatch)
    rng = random.Random(k)

    def made(n):
        some = odd_vectors(rng, 30)[0 if odd else 10 :]
        lists = [[rng.choice(some) for _ in range(rng.randint(1, 4))] for _ in range(n)]
        return ([None, [], [None], [[]]] if odd else []) + lists

    pages = spark.createDataFrame(list(enumerate(made(60))), "doc_id int, patches array<array<double>>")
    q = spark.createDataFrame(list(enumerate(made(25))), "query_id int, parts array<array<double>>")
    want = ranked(pages.crossJoin(q).select("query_id", "doc_id", F.round(V.max_sim(F.col("parts"), F.col("patches")), 6).alias("score")), k)
    assert rows_of(D.max_sim_search(pages, q, k)) == rows_of(want)


def test_cache_takes_the_earliest_of_equal_entries(spark, monkeypatch):
    small(monkeypatch)
    entries = spark.createDataFrame([(i, [1.0, float(i % 3)], f"r{i}") for i in range(100, 0, -1)] + [(1, [1.0, 1.0], "s1")], "entry_id long, vec array<double>, response string")
    q = spark.createDataFrame([(1, [1.0, 1.0]), (2, [0.0, -1.0]), (3, [1.0, 2.0]), (4, None), (5, [0.0, 0.0])], "query_id int, qvec array<double>")
    got = {r["query_id"]: (r["entry_id"], r["response"]) for r in D.cache_lookup(entries, q, 0.5).collect()}
    assert got == {1: (1, "s1"), 2: (None, None), 3: (2, "r2"), 4: (None, None), 5: (None, None)}


def test_rounded():
    x = np.array([0.0078125, -0.0078125, 0.1234565, 0.12345649999999, 1.0, 0.0, NAN, INF, -INF, 1e300, 123456789.1234565, 1e-9, -1e-9])
    want = [v if not np.isfinite(v) else float(Decimal(repr(float(v))).quantize(Decimal("1e-6"), ROUND_HALF_UP, blocks._WIDE)) for v in x]
    assert [str(v) for v in blocks.rounded(x)] == [str(v + 0.0) for v in want]


def test_many_pairs_in_little_time(spark):
    v = spark.range(12_000).select(F.col("id").alias("doc_id"), F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.sin(F.col("id") * i)).alias("vec"))
    q = v.filter("doc_id % 10 = 0").select(F.col("doc_id").alias("query_id"), F.col("vec").alias("qvec"))
    began = time.time()
    assert D.exact_search(v, q, 10).count() == 12_000
    assert time.time() - began < 30  # 14.4 million pairs
