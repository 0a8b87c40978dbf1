"""The sweep over chunk sizes in shared readings against a ranking of chunks for each size."""

import random

import pytest
from pyspark.sql import functions as F

from larkspur.functions.text import strip
from larkspur.operators.chunking import chunk_documents
from larkspur.operators.ranking import chunks_to_documents
from larkspur.operators.sparse import bm25
from larkspur.plans import suite


def _corpus(spark, extra=()):
    rng = random.Random(7)
    word = lambda: rng.choice(["a", "b", "c", "d", "e", "Été", "x_1", "ΟΔΟΣ", "don't", "\x1cf", "g\u2003h"])
    text = lambda: rng.choice([" ", "\n\n"]).join(" ".join(word() for _ in range(rng.randint(1, 9))) + rng.choice(".!?") for _ in range(rng.randint(1, 12)))
    docs = [(str(i), text()) for i in range(120)] + [("n", None), ("e", ""), ("w", " \n\n "), (None, "a b c. d e")]
    golden = [(i, " ".join(word() for _ in range(4)), [str(i), str(i + 1)], None) for i in range(12)] + [(90, None, ["1"], None)]
    return spark.createDataFrame([*docs, *extra], "doc_id string, text string"), spark.createDataFrame(golden, "query_id int, query string, relevant array<string>, gains map<string,double>")


@pytest.mark.parametrize("overlap", [0, 4])
@pytest.mark.parametrize("repeat", [False, True])
def test_sweep_is_that_of_chunks_by_themselves(spark, monkeypatch, overlap, repeat):
    docs, golden = _corpus(spark, [("3", "a b. c d e."), (None, "b c")] if repeat else [])
    monkeypatch.setattr(suite, "scorecard", lambda name, ranking, *_: ranking.withColumn("name", F.lit(name)))
    got = suite.chunk_sweep(docs, golden, (5, 12), overlap, 3, 6)
    want = None
    for size in (5, 12):
        chunks = chunk_documents(docs, size, overlap).select(F.col("id").alias("doc_id"), "text")
        leg = chunks_to_documents(bm25(chunks, golden, 6)).withColumn("name", F.lit(str(size)))
        want = leg if want is None else want.unionByName(leg)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(got) == rows(want) and got.count() > 60


def test_chunks_are_not_made_for_each_size(spark, monkeypatch):
    """Chunk ids used to be made and shuffled for each size only to see whether they repeat."""
    docs, golden = _corpus(spark)
    monkeypatch.setattr(suite, "chunk_documents", None)
    assert [r["name"] for r in suite.chunk_sweep(docs, golden, (5, 12), 0, 3, 6).collect()] == ["5", "12"]


def test_strip_as_the_pattern(spark):
    ends = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(c + "a" + c + "b" + c + "\n",) for c in ends] + [(c * 2,) for c in ends] + [(None,)], "s string")
    assert rows.filter(~strip(F.col("s")).eqNullSafe(F.regexp_replace("s", r"(?U)^\s+|\s+$", ""))).count() == 0
