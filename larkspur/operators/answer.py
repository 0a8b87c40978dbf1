"""Answers: the extractive answerer, grounded generation, reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from larkspur.functions import backends as B
from larkspur.functions.text import ABSTENTION, abstains, citations, number_passages, ranked_order, tokens
from larkspur.operators.ranking import ranked


def content_words(text: Column) -> Column:
    return F.array_except(tokens(text), F.array(*[F.lit(w) for w in B.STOPWORDS]))


def extract_answers(passages: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, text, citations, abstained: the passage sharing the most content words, cited by its position.

    ``passages`` has query_id, position (from 0) and text; ties fall to the
    earlier passage; without a shared word, or without passages, the answer abstains.
    """
    asked = queries.select("query_id", content_words(F.col("query")).alias("words"))
    scored = passages.select("query_id", "position", "text").join(asked, "query_id").withColumn("shared", F.size(F.array_intersect("words", content_words(F.col("text")))))
    best = scored.filter("shared > 0").groupBy("query_id").agg(F.max_by(F.struct("position", "text"), F.struct("shared", -F.col("position"))).alias("b"))
    out = queries.select("query_id").join(best, "query_id", "left")
    number = (F.col("b.position") + 1).cast("int")
    text = F.when(F.col("b").isNotNull(), F.concat(F.col("b.text"), F.lit(" ["), number.cast("string"), F.lit("]"))).otherwise(F.lit(ABSTENTION))
    return out.select("query_id", text.alias("text"), F.when(F.col("b").isNotNull(), F.array(number)).otherwise(F.array().cast("array<int>")).alias("citations"), F.col("b").isNull().alias("abstained"))


def generate_grounded(passages: DataFrame, queries: DataFrame, provider: str = "echo", system: str = "Answer from the numbered passages only and cite them.") -> DataFrame:
    """query_id, text, citations, abstained from a generation backend over numbered passages."""
    lists = passages.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda p: p["text"]).alias("p"))
    rows = queries.join(lists, "query_id", "left")
    prompt = F.concat(number_passages(F.coalesce("p", F.array().cast("array<string>"))), F.lit("\n\nQuestion: "), F.col("query"))
    said = rows.select("query_id", B.generate(F.lit(system), prompt, provider).alias("text"))
    return said.select("query_id", "text", citations(F.col("text")).alias("citations"), abstains(F.col("text")).alias("abstained"))


def rerank(passages: DataFrame, queries: DataFrame, k: int | None = None, provider: str = "overlap") -> DataFrame:
    """Ranking (query_id, doc_id, score, rank) by a pair-wise scoring backend."""
    both = passages.select("query_id", "doc_id", "text").join(queries.select("query_id", "query"), "query_id")
    return ranked(both.select("query_id", "doc_id", F.round(B.rerank_score(F.col("query"), F.col("text"), provider), 9).alias("score")), k or None)


def rerank_listwise(passages: DataFrame, replies: DataFrame, k: int = 0) -> DataFrame:
    """query_id, doc_id, rank from replies (query_id, reply) that list the passages' numbers; k = 0 keeps all."""
    lists = passages.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda p: p["doc_id"]).alias("ids"))
    rows = lists.join(replies, "query_id")
    order = F.transform(ranked_order(F.col("reply"), F.size("ids")), lambda i: F.get(F.col("ids"), i))
    rows = rows.select("query_id", F.posexplode(F.slice(order, 1, k) if k else order).alias("i", "doc_id"))
    return rows.select("query_id", "doc_id", (F.col("i") + 1).alias("rank"))


def harden(passages: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Passages without suspicious ones (all stay if all are suspicious), personal data redacted."""
    from larkspur.functions.security import is_suspicious, redact

    bad = passages.withColumn("__bad", is_suspicious(F.col("text"), threshold))
    bad = bad.withColumn("__good", F.max((~F.col("__bad")).cast("int")).over(Window.partitionBy("query_id")))
    kept = bad.filter(~F.col("__bad") | (F.col("__good") == 0)).drop("__bad", "__good")
    return kept.withColumn("text", redact(F.col("text"))[0])
