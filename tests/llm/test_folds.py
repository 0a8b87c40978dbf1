"""The quality model takes all trusted documents, whatever their number."""

from larkspur.llm import quality


def test_all_trusted_documents_are_used(spark):
    labels = spark.range(12_000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    held = {r["held"]: r["count"] for r in quality.sampled_ids(labels).groupBy("held").count().collect()}
    assert held[True] + held[False] == 12_000
    assert 0.17 < held[True] / 12_000 < 0.23


def test_rows_by_batches_of_ids(spark, monkeypatch):
    monkeypatch.setattr(quality, "IDS_AT_ONCE", 70)
    docs = spark.range(0, 1_000).selectExpr("id as doc_id", "concat('t', id) as text").union(spark.createDataFrame([(5, "again"), (None, "none")], "doc_id long, text string"))
    ids = spark.range(0, 500, 2).selectExpr("id as doc_id")
    got = sorted((r["doc_id"], r["text"]) for r in quality.rows_of(docs, ids.union(spark.createDataFrame([(5,)], "doc_id long"))).collect())
    assert got == sorted([(i, f"t{i}") for i in range(0, 500, 2)] + [(5, "t5"), (5, "again")])


def test_sums_handed_on_early(spark, monkeypatch):
    monkeypatch.setattr(quality, "COUNT_AT_ONCE", 5)
    monkeypatch.setattr(quality, "SUMS_AT_ONCE", 7)
    texts = spark.createDataFrame([(" ".join(f"w{chr(97 + i % 13)}" for i in range(j, j + 9)),) for j in range(40)], "text string").coalesce(2)
    sums = quality._summed(texts, lambda raw, offsets: quality.Tokens(raw, offsets).hashes.view("int64"), "token").collect()
    assert len(sums) == 13 and sum(r["n"] for r in sums) == 360


def test_frequent_middle_words_are_dealt_out_and_nothing_else_is_shuffled(spark, monkeypatch):
    """A shard is a few compressed arrays, whatever the number of its trigrams, and a frequent word has several."""
    monkeypatch.setattr(quality, "SHARD_GRAMS", 500)
    texts = spark.createDataFrame([(" ".join(f"the w{chr(97 + (i * j) % 23)}{chr(97 + i % 19)}" for i in range(40)),) for j in range(1, 60)], "text string")
    model, rows = quality.train(texts)
    kept = rows.collect()
    counted = [r for r in kept if r["kind"] == 0]
    assert {r["kind"] for r in kept} == {-1, 0} and len(counted) <= model.shards < 20
    assert model.parts.max() > 2
    grams = [g for r in counted for g in quality.np.cumsum(quality.unsqueeze(r["keys"], r["size"], quality.np.int64)).tolist()]
    assert len(grams) == len(set(grams)) > 1_000
    total = sum(int(quality.unsqueeze(r["counts"], r["size"], quality.np.int64).sum()) for r in counted)
    assert total == 59 * (80 + 1)
    for r in counted:
        own = quality.np.cumsum(quality.unsqueeze(r["keys"], r["size"], quality.np.int64))
        assert (quality.shard_of(own, model.parts, model.shards) == r["shard"]).all()
