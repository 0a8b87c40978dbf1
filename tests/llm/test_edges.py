"""Every operator and pipeline stage on nulls, empty and long texts, repeats, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import queries as Q

LONG = "lorem ipsum dolor " * 20_000
DOCS = [
    (1, "the quick brown fox jumps over the lazy dog again and again today", "en", "a", 5),
    (1, "the quick brown fox jumps over the lazy dog again and again today", "en", "a", 5),  # the row repeated
    (2, "The quick brown fox jumps over the lazy dog again and again TODAY", None, None, None),
    (3, None, "en", "b", None),
    (4, "", "de", "b", 0),
    (5, " \n\t ", "xx", "", 3),
    (6, LONG, "en", "a", 1),
    (7, "token = abcdefghijklmnop\nReleased under the MIT License.", "en", "c", 2),
    (None, "a row without an id", "en", "c", 2),
    (8, "zero\x00byte and \u2028 odd \U0001F600 characters", "fr", "d", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASH = ["size", "rank", "key", "n", "term", "score", "kept", "root", "band", "shingles", "item_id", "copies", "target", "spans", "base", "row", "copy", "rows", "turn", "text_key", "key1", "key2", "held", "piece", "__id", "__key", "__low", "__copies", "__turn", "__text"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))

    def put(kind, docs, pages, bench, labels, vectors):
        extra = lambda df: df.withColumns({c: F.lit("x") for c in CLASH if c not in df.columns})
        extra(spark.createDataFrame(docs, SCHEMA)).write.parquet(f"{path}/{kind}/documents.parquet")
        extra(spark.createDataFrame(pages, "page_id long, url string, html string")).write.parquet(f"{path}/{kind}/pages.parquet")
        spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/{kind}/benchmark.parquet")
        extra(spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).write.parquet(f"{path}/{kind}/labels.parquet")
        extra(spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")).write.parquet(f"{path}/{kind}/embeddings.parquet")

    pages = [(1, None, None), (2, "no scheme", ""), (2, "no scheme", ""), (None, "http://", "<p>x"), (3, "HTTP://A.Example.ORG/es/x?y#z", "<article>t</article>"), (4, "x://com/fr/", LONG)]
    bench = [(1, "quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (None, "x y z"), (4, "again"), (1, "quick brown fox jumps over the lazy dog")]
    labels = [(1, 1, 0), (6, 1, 0), (2, None, None), (3, 1, 0), (None, 1, 0), (4, 0, 1), (1, 1, 0)]
    vectors = [(0, [0.5] * 64, 1), (20, None, 1), (40, [0.1] * 3, 1), (1, [-0.5] * 64, 1), (2, [0.5] * 64, 1), (None, [0.5] * 64, 1), (2, [0.5] * 64, 1), (60, [0.5] * 63 + [None], 1)]
    put("odd", DOCS, pages, bench, labels, vectors)
    put("none", [], [], [], [], [])
    return path


@pytest.mark.parametrize("name", list(Q.queries()))
def test_odd_rows_and_empty_tables(spark, folder, name):
    odd = Q.queries()[name](spark, f"{folder}/odd").collect()
    none = Q.queries()[name](spark, f"{folder}/none").collect()
    assert none == []
    per_document = {"op1", "op3", "op4", "op5", "op6", "op9"}
    n = name.split("_")[0]
    if n in per_document:
        assert len(odd) == len(DOCS)
    if n in {"op7", "op10"}:
        assert len(odd) == 6


def test_results_of_odd_rows(spark, folder):
    at = f"{folder}/odd"
    near = {r["doc_id"]: r for r in Q.op6_minhash_neardup(spark, at).collect()}
    assert near[2]["component_id"] == 1 and not near[2]["kept"] and near[1]["kept"]
    assert near[3]["n_shingles"] == 0 and near[3]["component_id"] == 3 and near[5]["component_id"] == 5
    assert near[8]["n_shingles"] == 3  # NUL parts no words: six words
    assert near[None]["component_id"] is None and not near[None]["kept"]
    verdicts = {r["page_id"]: r for r in Q.op10_url_rules(spark, at).collect()}
    assert (verdicts[3]["host"], verdicts[3]["path"], verdicts[3]["rule"], verdicts[3]["verdict"]) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert verdicts[4]["rule"] == "com/fr/" and verdicts[1]["host"] == "" and verdicts[2]["rule"] is None
    leaks = {(r["doc_id"], r["item_id"]) for r in Q.op8_benchmark_decontamination(spark, at).collect()}
    assert (1, 1) in leaks and (2, 1) in leaks and not any(d in (6, 7) for d, _ in leaks)
    top = Q.op2_hamming_topk(spark, at).collect()
    assert sorted((r["query_id"], r["id"], r["distance"], r["rank"]) for r in top) == [(0, 1, 64, 2), (0, 2, 0, 1)]
    secrets = {r["doc_id"]: r for r in Q.op5_secret_scan(spark, at).collect()}
    assert secrets[7]["n_assign"] == 1 and secrets[7]["spans"] == "assign:0:24" and secrets[3]["spans"] == ""
    licences = {r["doc_id"]: r for r in Q.op3_license_scan(spark, at).collect()}
    assert licences[7]["license"] == "MIT" and licences[7]["start"] == 2 and licences[7]["n_words"] == 5 and licences[3]["license"] is None
    judged = {r["doc_id"]: r for r in Q.op1_quality_classifier(spark, at).collect()}
    assert not judged[3]["kept"] and judged[3]["log_perplexity"] is None and judged[1]["kept"]


def test_copies_without_an_id_are_one_document(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text, "en", "a", 1), (None, text, "en", "b", 2), (None, text + " end", "en", "a", 1), (7, text, "en", "a", 1), (None, "all by itself here", "en", "a", 1), (None, "all by itself here", "de", "a", 1), (None, None, "en", "a", 1), (None, None, "en", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = sorted((str(r["doc_id"]), str(r["text"])[:5]) for r in corpus_pipeline.deduplicate(spark, docs, "").collect())
    assert kept == [("7", "w0 w1"), ("None", "None"), ("None", "all b")]


def test_stages_on_odd_rows_and_empty_tables(spark, folder):
    for kind in ("odd", "none"):
        docs = spark.read.parquet(f"{folder}/{kind}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, f"{folder}/{kind}")
            rows = out.collect()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns, name
                assert all(r[c] == "x" for r in rows for c in CLASH), name
            assert kind == "odd" or rows == [], name


def test_stage_results(spark, folder):
    at = f"{folder}/odd"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    once = sorted(str(r["doc_id"]) for r in stages["MinHash near-dedup"](spark, docs, at).collect())
    assert once == ["1", "3", "4", "5", "6", "7", "8", "None"]
    clean = [r["doc_id"] for r in stages["benchmark decontamination"](spark, docs, at).collect()]
    assert 1 not in clean and 2 not in clean and {3, 4, 5, 6, 7, 8, None} <= set(clean)
    mixed = stages["mixing sources to target weights"](spark, docs, at).groupBy("doc_id").count().collect()
    planned = {r["doc_id"]: 0 for r in mixed}
    for r in Q.op4_source_mixing(spark, at).collect():
        planned[r["doc_id"]] = planned.get(r["doc_id"], 0) + r["copies"]
    assert {r["doc_id"]: r["count"] for r in mixed} == {k: v for k, v in planned.items() if v}
