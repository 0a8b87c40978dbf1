"""Exact top-k search over binary codes by incremental multi-index hashing.

Vectors become 64-bit codes of their signs.  A code is cut into four segments of
16 bits, each with a table from segment value to codes, which is one DataFrame
sharded by (segment, value).  A query looks up all segment values within radius 0,
then 1, 2 and so on: once radius r is done in every segment, every code within
distance ``4 * (r + 1) - 1`` has been seen (pigeonhole), so a query leaves the
search as soon as its k-th verified distance is within that.

A round is one join: the values to look up, of the queries that are still
searching, meet the table by (segment, value).  A code counts in the round of the
least of its four segment distances and in the first segment that has it, so none
is verified twice, and only codes no farther than the k-th best so far come out of
the join.  Each query's best are cut per task before they are shuffled.

Codes, not rows, are indexed: rows of equal code share one entry that carries
their k smallest ids, which is all that a top k with ties by id can take from
them.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from larkspur.llm.frames import cut

SEGMENTS = 4
SEGMENT_BITS = 16


def masks(radius: int) -> list[int]:
    """All segment values with ``radius`` bits."""
    return [sum(1 << b for b in some) for some in combinations(range(SEGMENT_BITS), radius)]


def _segment(code: Column, s: int) -> Column:
    return F.call_function("shiftright", code, F.lit(SEGMENT_BITS * s)).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1)).cast("int")


def sign_codes(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """id, code: bit i is set where component i of 64 is above 0; null for other lengths and nulls."""
    bits = F.transform(F.col("v"), lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")))
    shifted = F.transform(F.arrays_zip(bits.alias("b"), F.sequence(F.lit(0), F.lit(63)).alias("i")), lambda z: F.call_function("shiftleft", z["b"], z["i"]))
    code = F.aggregate(shifted, F.expr("0L"), lambda a, b: a.bitwiseOR(b))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v"))
    return rows.select("id", F.when((F.size("v") == 64) & ~F.exists("v", lambda x: x.isNull()), code).alias("code"))


def hamming_top_k(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, id, distance and rank (1 to k, by distance, then id) of the k nearest rows of each query.

    ``codes`` and ``queries`` have id and code (long); a query's own id is not
    among its answers.  Rows with a null id or code neither ask nor answer; ids
    are taken to be unique, and of an id that comes twice with one code one row
    counts.  With fewer than k other rows all are returned; an empty table on
    either side gives an empty result.  Other columns are ignored.
    """
    rows = codes.filter("id is not null and code is not null").select("id", "code")
    # One id more than k: the query's own may be among them.
    few = k + 1
    salted = Window.partitionBy("code", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    least = rows.distinct().withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= few)
    least = least.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy("id"))).filter(F.col("r") <= few)
    entries = least.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    places = F.explode(F.array(*[F.struct(F.lit(s).alias("segment"), _segment(F.col("code"), s).alias("value")) for s in range(SEGMENTS)]))
    index = cut(entries.select("code", "ids", places.alias("place")).select("place.*", "code", "ids"))
    asked = cut(queries.filter("id is not null and code is not null").select(F.col("id").alias("query_id"), "code").distinct())
    # far: the distance that a code must not exceed to be among the query's best.
    active = cut(asked.select(F.col("code").alias("query")).distinct().withColumn("far", F.lit(64)))
    best: DataFrame | None = None
    done: list[DataFrame] = []
    in_order = Window.partitionBy("query").orderBy("distance", "id")
    for radius in range(SEGMENT_BITS + 1):
        if active.isEmpty():
            break
        looked = F.explode(F.array(*[F.struct(F.lit(s).alias("segment"), _segment(F.col("query"), s).alias("own")) for s in range(SEGMENTS)]))
        probes = active.select("query", "far", looked.alias("l")).select("query", "far", "l.*", F.explode(F.array(*map(F.lit, masks(radius)))).alias("mask"))
        probes = probes.select("query", "far", "segment", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
        hits = probes.join(index, ["segment", "value"])
        distance = F.bit_count(F.col("query").bitwiseXOR(F.col("code"))).cast("int")
        apart = [F.bit_count(_segment(F.col("query").bitwiseXOR(F.col("code")), s)) for s in range(SEGMENTS)]
        first = distance <= F.col("far")
        for s, d in enumerate(apart):
            first = first & ((d > radius) | ((d == radius) & (F.col("segment") <= s)))
        found = hits.filter(first).select("query", distance.alias("distance"), F.explode("ids").alias("id"))
        every = found if best is None else found.unionByName(best)
        best = cut(every.withColumn("place", F.row_number().over(in_order)).filter(F.col("place") <= few).drop("place"))
        covered = SEGMENTS * (radius + 1) - 1
        sizes = best.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"))
        full = F.coalesce(F.col("n") == few, F.lit(False))
        state = cut(active.select("query").join(sizes, "query", "left").select("query", F.when(full, F.col("far")).otherwise(64).alias("far"), ((full & (F.col("far") <= covered)) | F.lit(covered >= 64)).alias("ended")))
        done.append(best.join(state.filter("ended").select("query"), "query", "left_semi"))
        active = state.filter("not ended").select("query", "far")
        best = best.join(active.select("query"), "query", "left_semi")
    if not done:
        return asked.select("query_id", F.col("query_id").alias("id"), F.lit(0).alias("distance"), F.lit(1).alias("rank")).filter("false")
    answers = reduce(DataFrame.unionByName, done)
    out = asked.join(answers.withColumnRenamed("query", "code"), "code").filter("id <> query_id")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "code").orderBy("distance", "id")).cast("int"))
    return out.filter(F.col("rank") <= k).select("query_id", "id", "distance", "rank")


TOP_K_SQL = """
WITH bits AS (
  SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END) AS b FROM embeddings),
codes AS (SELECT vec_id, list_aggregate(b, 'string_agg', '')::BIT AS code FROM bits),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS id, bit_count(xor(q.code, c.code))::INTEGER AS distance
  FROM codes q JOIN codes c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INTEGER AS rank FROM pairs)
SELECT query_id, id, distance, rank FROM ranked WHERE rank <= 10
"""
