"""BM25 over a corpus, for all queries of a batch in one plan.

The corpus is read twice.  First a task counts its documents, their lengths and
those that have a term that some query asks for; these totals are all that is
gathered.  Then it scores its documents and hands on the best k of each query, so
neither terms nor scores of all documents are shuffled or kept.  Only ids that come
more than once make terms meet by id, in joins of all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from larkspur.frames import cut, is_small, join_small
from larkspur.functions.text import tokens
from larkspur.operators.blocks import Best, Bm25, meet, term_counts
from larkspur.operators.ranking import PLACES, ranked

K1, B = 1.5, 0.75
#: Stands for the document itself among its terms; no token is empty.
_DOCUMENT = ""
#: Terms of queries that go to every task at once.
BATCH_TERMS = 1 << 20
Views = Callable[[pa.RecordBatch, pa.Array], Iterable[tuple[pa.Array, pa.Array]]]


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, qtf of (query_id, query); a repeated term counts as often as it comes."""
    words = queries.select("query_id", F.explode_outer(tokens(F.col("query"))).alias("term")).filter("term is not null")
    return words.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def postings(docs: DataFrame) -> DataFrame:
    """term, doc_id, tf, dl of (doc_id, text)."""
    return _frequencies(docs).filter(F.col("term") != _DOCUMENT)


def _frequencies(docs: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """term, doc_id, dl, tf, of asked terms (term) if given, and a row of each document for itself.

    The list is exploded with its mark, so it is never empty and the plan needs no
    filter on its size, for which texts would be tokenised once more.
    """
    split = docs.select("doc_id", F.concat(F.array(F.lit(_DOCUMENT)), tokens(F.col("text"))).alias("t"))
    rows = split.select("doc_id", (F.size("t") - 1).alias("dl"), F.explode_outer("t").alias("term"))
    if asked is not None:
        wanted = asked.unionByName(asked.sparkSession.range(1).select(F.lit(_DOCUMENT).alias("term")))
        rows = join_small(rows, wanted, "term", "left_semi")
    return rows.groupBy("term", "doc_id", "dl").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: n and avgdl (0 without documents)."""
    return docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.size(tokens(F.col("text")))), F.lit(0.0)).alias("avgdl"))


def idf(df, n):
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def term_weights(docs: DataFrame) -> DataFrame:
    """term, df, idf of all terms."""
    marked = F.concat(F.array(F.lit(_DOCUMENT)), F.array_distinct(tokens(F.col("text"))))
    terms = cut(docs.select(F.explode_outer(marked).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    n = terms.filter(F.col("term") == _DOCUMENT).select(F.col("df").alias("n"))
    return terms.filter(F.col("term") != _DOCUMENT).crossJoin(F.broadcast(n)).select("term", "df", F.round(idf(F.col("df"), F.col("n")), PLACES).alias("idf"))


def bm25(docs: DataFrame, queries: DataFrame, k: int | None = 10, k1: float = K1, b: float = B) -> DataFrame:
    """The ``k`` best documents with a score above 0 of each query.

    Rows that repeat a doc_id with a text of the same length count as one document
    of both; a null text has no terms.
    """
    asked = cut(query_terms(queries))
    if k is None or not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return _all_scores(docs, asked, k, k1, b)
    rows = docs.select("doc_id", tokens(F.col("text")).alias("words"))
    return ranked(_together(rows, asked, queries.schema["query_id"], rows.schema["doc_id"], 1, lambda batch, _: [batch.columns], k, k1, b).drop("leg"), k)


def rankings(rows: DataFrame, queries: DataFrame, count: int, views: Views, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """leg, query_id, doc_id, score, rank: ``count`` rankings by BM25 that share the reading of ``rows``, of corpora whose ids don't repeat.

    Of a batch and the asked terms ``views`` gives each leg's ids and lists of terms, or
    of their numbers among those asked (-1: none).
    """
    scores = _together(rows, cut(query_terms(queries)), queries.schema["query_id"], StructField("doc_id", StringType()), count, views, k, k1, b)
    return ranked(scores, k, ("leg", "query_id"))


def _together(rows: DataFrame, asked: DataFrame, query_id: StructField, doc_id: StructField, count: int, views: Views, k: int, k1: float, b: float) -> DataFrame:
    """leg, query_id, doc_id, score above 0: at least the best k of each query in each leg."""
    n = max(1, -(-asked.count() // BATCH_TERMS))
    part = F.pmod(F.xxhash64("query_id"), F.lit(n))
    parts = [_best(rows, asked if n == 1 else asked.filter(part == i), query_id, doc_id, count, views, k, k1, b) for i in range(n)]
    return reduce(DataFrame.unionByName, parts).filter("score > 0")


def _best(rows: DataFrame, asked: DataFrame, query_id: StructField, doc_id: StructField, legs: int, views: Views, k: int, k1: float, b: float) -> DataFrame:
    """leg, query_id, doc_id, score: each task's best k of its rows, for a bounded number of asked terms."""
    spark = rows.sparkSession
    table = asked.toArrow().combine_chunks()  # BATCH_TERMS rows
    ids = table.column("query_id").combine_chunks().dictionary_encode(null_encoding="encode")
    terms = table.column("term").combine_chunks().dictionary_encode()
    query, term = ids.indices.to_numpy().astype(np.int64), terms.indices.to_numpy().astype(np.int64)
    known = spark.sparkContext.broadcast(terms.dictionary)
    count = len(terms.dictionary)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each leg documents with each term; then how many there are, and their lengths."""
        total = np.zeros((legs, count + 2), np.int64)
        for batch in batches:
            for leg, (_, words) in zip(total, views(batch, known.value)):
                _, term, _, length = term_counts(words, known.value)
                leg[:count] += np.bincount(term, minlength=count)
                leg[count:] += [len(length), length.sum()]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int64()), "n": pa.array(total.reshape(-1)[at], pa.int64())})

    sums = rows.mapInArrow(tally, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    totals = np.zeros(legs * (count + 2), np.int64)
    totals[sums.column("at").to_numpy()] = sums.column("n").to_numpy()
    order = np.argsort(term, kind="stable")
    first, kernels = np.searchsorted(term[order], np.arange(count + 1)), []
    for total in totals.reshape(legs, count + 2):
        df, n, length = total[:count], int(total[count]), int(total[count + 1])
        weight = table.column("qtf").to_numpy()[order] * np.log((n - df + 0.5) / (df + 0.5) + 1)[term[order]]
        kernels.append(Bm25(len(ids.dictionary), terms.dictionary, first, query[order], weight, length / max(1, n) or 1.0, k1, b))
    shared = spark.sparkContext.broadcast((kernels, ids.dictionary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernels, ids = shared.value
        best = [Best(kernel.count, k, kernel.floor) for kernel in kernels]
        for batch in batches:
            for one, kernel, view in zip(best, kernels, views(batch, known.value)):
                meet(one, kernel, pa.RecordBatch.from_arrays(list(view), ["doc_id", "words"]))
        for leg, one in enumerate(best):
            for out in one.batches(ids):
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(leg, pa.int32()), len(out)), *out.columns], ["leg", *out.schema.names])

    return rows.mapInArrow(run, StructType([StructField("leg", IntegerType()), query_id, doc_id]).add("score", "double"))


def _all_scores(docs: DataFrame, asked: DataFrame, k: int | None, k1: float, b: float) -> DataFrame:
    """The ranking by joins of terms: without a limit, or of documents whose rows have to meet by id."""
    table = cut(_frequencies(docs, asked.select("term").distinct()))
    own = F.col("term") == _DOCUMENT
    stats = table.filter(own).agg(F.sum("tf").alias("n"), (F.sum(F.col("tf") * F.col("dl")) / F.sum("tf")).alias("avgdl"))  # one row
    hits = table.filter(~own)
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = asked.join(df, "term").crossJoin(F.broadcast(stats)).select("query_id", "term", "qtf", "avgdl", idf(F.col("df"), F.col("n")).alias("idf"))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    terms = F.broadcast(terms) if is_small(asked) else terms
    scores = hits.join(terms, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(part), PLACES).alias("score"))
    return ranked(scores.filter("score > 0"), k)
