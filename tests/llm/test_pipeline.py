"""The pipeline's rows against its stages by brute force, and the queries against their SQL."""

import os

import duckdb
import pytest

import corpus_pipeline
from larkspur.llm import queries as Q
from larkspur.llm.neardup import near_duplicates
from larkspur.llm.quality import judge

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", list(Q.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = Q.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    cur = con.execute(Q.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == sorted(repr([r[names.index(c)] for c in columns]) for r in cur.fetchall())


def test_stages_follow_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        seen.append(docs)
    first = spark.read.parquet(f"{FOLDER}/documents.parquet")
    good = {r["doc_id"] for r in judge(first, spark.read.parquet(f"{FOLDER}/labels.parquet")).filter("kept").collect()}
    assert {r["doc_id"] for r in seen[0].collect()} == good
    kept = {r["doc_id"] for r in near_duplicates(seen[0], 5, 80).filter("kept").collect()}
    assert sorted(r["doc_id"] for r in seen[1].collect()) == sorted(kept)
    items = [r["text"].lower() for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    leaks = {r["doc_id"] for r in seen[1].collect() if any(i in (r["text"] or "").lower() for i in items)}
    assert {r["doc_id"] for r in seen[1].collect()} - {r["doc_id"] for r in seen[2].collect()} >= leaks
    assert seen[4].count() == seen[3].count()
    run = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, seen[4].collect()))
