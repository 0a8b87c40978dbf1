"""Suites, the cache's files, page vectors, tracing."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from larkspur.operators import multivector as V
from larkspur.plans import suite, tracing
from larkspur.operators.dense import SemanticRouter
from larkspur.registry import backends
from larkspur.sources import readers
from larkspur.sources.cache import SemanticCache


def test_suites(spark):
    corpus = spark.createDataFrame([("a", "Cats", "They purr. They sleep all day long."), ("b", "Dogs", "They bark at cats. Loud."), ("c", "Fish", "They swim.")], "id string, title string, text string")
    golden = spark.createDataFrame([(1, "cats", ["a"], None), (2, "bark", ["b"], None)], "query_id int, query string, relevant array<string>, gains map<string,double>")
    cards = {r["name"]: r for r in suite.body_and_title(corpus, golden).collect()}
    assert cards["body"]["recall"] == 0.5 and cards["body+title"]["recall"] == 1.0
    sweep = suite.chunk_sweep(corpus.select(F.col("id").alias("doc_id"), "text"), golden, (3, 50))
    assert {r["name"]: r["recall"] for r in sweep.collect()} == {"3": 0.5, "50": 0.5}


#: A sample corpus and its golden queries, for which scores are published.
SAMPLE = [
    ("d1", "Refund Policy", "Customers may request a refund within thirty days of purchase. Refunds are issued to the original payment method."),
    ("d2", "Connection Errors", "The error code ERR_CONN_4021 indicates the server refused the connection during the TLS handshake."),
    ("d3", "Shipping Times", "Standard delivery takes five to seven business days. Express delivery arrives in two business days."),
    ("d4", "Account Security", "Enable two-factor authentication to protect your account. Passwords must be at least twelve characters long."),
    ("d5", "Data Retention", "Logs are kept for ninety days and then permanently deleted from all systems."),
    ("d6", "Rate Limits", "The API allows one thousand requests per minute. Exceeding the limit returns a 429 status code."),
    ("d7", "Subscription Plans", "The Pro tier includes priority support and unlimited projects. The Free tier is limited to three projects."),
    ("d8", "Password Reset", "To reset a forgotten password, click the forgot-password link and follow the emailed instructions."),
]
ASKED = [("refund within thirty days", "d1"), ("ERR_CONN_4021 handshake", "d2"), ("rate limit 429 requests", "d6"), ("express delivery business days", "d3"), ("two-factor authentication password", "d4"), ("forgotten password reset link", "d8"), ("subscription pro free tier", "d7"), ("retention policy", "d5")]


def test_published_scores(spark):
    corpus = spark.createDataFrame(SAMPLE, "id string, title string, text string")
    golden = spark.createDataFrame([(i, q, [d], None) for i, (q, d) in enumerate(ASKED)], "query_id int, query string, relevant array<string>, gains map<string,double>")
    cards = {r["name"]: (round(r["ndcg"], 4), r["recall"], r["mrr"]) for r in suite.body_and_title(corpus, golden).collect()}
    assert cards == {"body": (0.8750, 0.875, 0.875), "body+title": (0.9077, 1.0, 0.875)}


def test_router(spark):
    rows = spark.createDataFrame([(1, "refunds", "i want my money back"), (2, "errors", "the server refused the connection"), (3, "refunds", "refund please")], "utt_id int, label string, utterance string")
    router = SemanticRouter().add(rows.filter("utt_id < 3")).add(rows.filter("utt_id = 3"))
    asked = spark.createDataFrame([(1, "please a refund"), (2, "connection refused by server")], "query_id int, query string")
    assert {r["query_id"]: r["label"] for r in router.route(asked).collect()} == {1: "refunds", 2: "errors"}
    with pytest.raises(ValueError):
        SemanticRouter().route(asked)


def test_parsers_and_file_heads(spark, tmp_path):
    page = "<!DOCTYPE html><html><body><p>" + "é" * 600 + "</p></body></html>"
    (tmp_path / "a.html").write_bytes(b"\n" + page.encode())
    (tmp_path / "b.pdf").write_bytes(b"%PDF-words")
    found = {r["path"][-1]: r for r in readers.files(spark, str(tmp_path)).collect()}
    assert found["l"]["content_type"] == "text/html" and found["l"]["text"] == "é" * 600 and found["f"]["text"] is None
    backends.register("parser", "application/pdf", lambda content: content.map(lambda c: bytes(c)[5:].decode()))
    rows = spark.createDataFrame([("b.pdf", b"%PDF-words", "application/pdf", None), ("c", b"x", "text/plain", "x")], "path string, content binary, content_type string, text string")
    assert {r["path"]: r["text"] for r in readers.parse_with(rows, "application/pdf").collect()} == {"b.pdf": "words", "c": "x"}


def test_shared_folder(spark):
    from larkspur import frames

    assert frames.shared_dir(spark)
    assert frames.is_small(spark.range(3), 3) and not frames.is_small(spark.range(4), 3)


def test_cache_files(spark, tmp_path):
    cache = SemanticCache(spark, str(tmp_path / "cache"))
    asked = spark.createDataFrame([(1, "what is the refund policy"), (2, "zebra")], "query_id int, query string")
    assert {r["response"] for r in cache.get(asked).collect()} == {None}
    cache.put(spark.createDataFrame([(1, "what is the refund policy", "thirty days")], "entry_id int, query string, response string"))
    cache.put(spark.createDataFrame([(2, "what is the refund policy", "later")], "entry_id int, query string, response string"))
    assert {r["query_id"]: r["response"] for r in cache.get(asked).collect()} == {1: "thirty days", 2: None}


def test_pages(spark):
    backends.register("page", "fixed", lambda images: pd.Series([[[1.0, 0.0], [0.9, 0.1], [0.0, 1.0]]] * len(images)))
    pages = spark.createDataFrame([(1, b"x")], "doc_id int, image binary")
    assert len(V.index_pages(pages, "fixed").first()["patches"]) == 3
    assert V.index_pages(pages, "fixed", 2).first()["patches"] == [[0.95, 0.05], [0.0, 1.0]]
    with pytest.raises(ValueError):
        V.index_pages(pages, "other")


def test_tracing(spark):
    with tracing.trace(spark, "count"):
        df, seen = tracing.observed(spark.range(5), "rows", n=F.count(F.lit(1)))
        df.collect()
    assert seen.get == {"n": 5}
