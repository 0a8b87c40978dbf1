"""Mixing sources to target weights by systematic sampling.

Targets: every source has a weight; all share a given multiple of all words by
weight, no source gets more than ``most`` times its own words, and what is cut
off is shared again by weight.  This is water filling: the target is
``min(most * size, level * weight)``, and the level is the largest of
``(total - caps of the k lowest) / (weight of the rest)`` over k, taking sources
by ``cap / weight``.

Copies: in a source each document is expected ``target / size`` times.  In the
order (size, doc_id) the expected copies are summed up, one random offset per
source is added, and a document is taken once for each integer that its interval
crosses.  Ordering by size makes the taken words follow the target closely; the
offset is a hash of the source and the seed, so reruns agree.

Documents are ranked without gathering a source in one task: rows are range
partitioned by (source, size, doc_id), counts per (partition, source) give
offsets, and rows are numbered inside these bounded pieces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from larkspur.llm.frames import cut, shuffle_width

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target for every source of ``sizes`` (source, size).

    Sources take the weights in turn, by code point with null last.  This table
    has a row per source, the only one that is ordered as a whole.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((turn - 1) % len(weights) + 1).cast("int"))
    t = total.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    low_first = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = low_first.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    t = t.withColumn("level", left / rest)
    t = t.withColumn("level", F.max("level").over(whole))
    return t.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def sampled_copies(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """doc_id, text_key, source, size, source_size, target, copies for every row of ``docs``.

    ``docs`` has doc_id, text and source; other columns are ignored.  A null text
    has size 0; null is a source of its own; sources without words are given and
    take nothing.  Rows that repeat a doc_id are sampled one by one.  An empty
    table gives an empty result.  Texts of any length are counted as a whole.
    """
    rows = cut(docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("text_key"), word_count(F.col("text")).alias("size")))
    targets = source_targets(rows, weights, share, most)
    order = ["size", "doc_id", "text_key"]
    placed = rows.repartitionByRange(shuffle_width(docs.sparkSession), "source", *order).withColumn("piece", F.spark_partition_id())
    placed = cut(placed)
    same = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("key")
    pieces = placed.groupBy("piece", "source").agg(F.count(F.lit(1)).alias("n"))
    pieces = pieces.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("piece")) - F.col("n"))
    t = targets.select(same, "source_size", "target")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("key"))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    pieces = pieces.select("piece", same, "before").join(t, "key").select("piece", "key", "before", "source_size", "target", offset.alias("offset"))
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("piece", "source").orderBy(*order)))
    ranked = ranked.select("*", same).join(pieces, ["piece", "key"])
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    upto = F.col("before") + F.col("rank")
    crossed = F.floor(F.col("offset") + upto * expected) - F.floor(F.col("offset") + (upto - 1) * expected)
    return ranked.select("doc_id", "text_key", "source", "size", "source_size", "target", crossed.cast("int").alias("copies"))


def mix_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """The rows of ``docs``, each as often as it is taken, with all their columns, whatever these are called.

    Rows that repeat a doc_id and source with the same text share out their
    copies.  A document without words, as of a null or empty text, is taken like
    any other of its source, unless the source has no words at all, which then
    gives nothing; a null source is one of its own, and null doc_ids do no harm.
    An empty table gives an empty one.
    """
    plan = sampled_copies(docs, weights, share, most, seed).groupBy(F.struct("doc_id", "text_key", "source").alias("key")).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")).filter("copies > 0")
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    own = own.select("row", F.struct(F.col("row.doc_id").alias("doc_id"), F.xxhash64("row.text").alias("text_key"), F.col("row.source").cast("string").alias("source")).alias("key"))
    # The join has dealt rows out by key, as the window needs them; rows rarely share one.
    joined = own.join(plan.hint("merge"), "key")
    turn = F.when(F.col("rows") > 1, F.row_number().over(Window.partitionBy("key").orderBy("key"))).otherwise(1)
    joined = joined.select("row", "copies", "rows", turn.alias("turn"))
    times = F.floor(F.col("turn") * F.col("copies") / F.col("rows")) - F.floor((F.col("turn") - 1) * F.col("copies") / F.col("rows"))
    return joined.select("row", F.explode(F.array_repeat(F.lit(0), times.cast("int"))).alias("copy")).select("row.*")


def mixture(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and source for every row of ``docs``.

    What ``sampled_copies`` says of nulls, repeats and empty tables holds; taken is
    0 for a text without words however often it is taken.
    """
    plan = sampled_copies(docs, weights, share, most, seed)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), F.col("copies").cast("int").alias("copies"), "source")


MIXTURE_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
weighted AS (
  SELECT *, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight,
         2.0::DOUBLE * source_size AS cap
  FROM totals),
levels AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / (sum(weight) OVER ()
               - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) AS level
  FROM weighted),
targets AS (
  SELECT source, source_size, least(cap, (SELECT max(level) FROM levels) * weight) AS target,
         ('0x' || substr(md5('0:' || coalesce('s' || source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS start
  FROM levels),
ranked AS (
  SELECT r.doc_id, r.source, r.size, t.source_size, t.target, t.start,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS expected,
         row_number() OVER (PARTITION BY r.source ORDER BY r.size, r.doc_id) AS k
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(start + k * expected) - floor(start + (k - 1) * expected)))::BIGINT AS taken,
       (floor(start + k * expected) - floor(start + (k - 1) * expected))::INTEGER AS copies,
       source
FROM ranked
"""
