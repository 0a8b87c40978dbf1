"""Small knowledge graphs as edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larkspur.frames import cut
from larkspur.functions.text import strip, triple_lines


def _tidy(name: str) -> Column:
    return strip(F.regexp_replace(F.col(name), r"(?U)\s+", " "))


def edges_from_triples(triples: DataFrame) -> DataFrame:
    """ord, subject, relation, object of (ord, subject, relation, object): tidy, unified, without repeats.

    White space is collapsed; an entity keeps its first spelling, a subject's
    before an object's in one triple; triples with blanks go, and of triples that
    differ in case only the first stays.
    """
    t = triples.select("ord", *[_tidy(c).alias(c) for c in ("subject", "relation", "object")])
    t = t.filter("subject <> '' and relation <> '' and object <> ''")
    names = t.select("ord", F.posexplode(F.array("subject", "object")).alias("at", "name"))
    spelled = names.groupBy(F.lower("name").alias("low")).agg(F.min_by("name", F.struct("ord", "at")).alias("spelling"))
    keyed = t.groupBy(F.lower("subject").alias("s"), F.lower("relation").alias("r"), F.lower("object").alias("o")).agg(F.min(F.struct("ord", "relation")).alias("first"))
    out = keyed.join(spelled.select(F.col("low").alias("s"), F.col("spelling").alias("subject")), "s").join(spelled.select(F.col("low").alias("o"), F.col("spelling").alias("object")), "o")
    return out.select(F.col("first.ord").alias("ord"), "subject", F.col("first.relation").alias("relation"), "object")


def parse_edges(replies: DataFrame) -> DataFrame:
    """Edges from model replies (ord, reply) with a triple per line."""
    rows = replies.select("ord", F.posexplode(triple_lines(F.col("reply"))).alias("at", "t"))
    return edges_from_triples(rows.select((F.col("ord") * 1_000_000 + F.col("at")).alias("ord"), "t.*"))


def entities(edges: DataFrame) -> DataFrame:
    """entity: all names, each once."""
    return edges.select(F.explode(F.array("subject", "object")).alias("entity")).distinct()


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """seed, entity, hop: what each seed (seed) reaches over edges in either direction, itself at hop 0.

    Each hop joins the last hop's entities with the edges and leaves out what has
    been visited; lineage is cut in the shared checkpoint folder.
    """
    both = edges.select(F.col("subject").alias("a"), F.col("object").alias("b")).union(edges.select("object", "subject"))
    names = entities(edges)
    visited = seeds.join(names, F.lower("seed") == F.lower("entity")).select("seed", "entity", F.lit(0).alias("hop"))
    last = visited
    for hop in range(1, hops + 1):
        found = last.select("seed", F.col("entity").alias("a")).join(both, "a").select("seed", F.col("b").alias("entity")).distinct()
        last = found.join(visited.select("seed", "entity"), ["seed", "entity"], "left_anti").withColumn("hop", F.lit(hop))
        last = cut(last)
        visited = visited.union(last)
    return visited


def inner_edges(edges: DataFrame, visited: DataFrame) -> DataFrame:
    """seed, ord, subject, relation, object of edges whose both ends a seed has visited."""
    ends = visited.select("seed", "entity")
    return edges.join(ends.withColumnRenamed("entity", "subject"), "subject").join(ends.withColumnRenamed("entity", "object"), ["seed", "object"]).select("seed", "ord", "subject", "relation", "object")


def facts(edges: DataFrame) -> DataFrame:
    """One row (facts): all triples as lines, for one synthesis call over a small graph."""
    line = F.concat(F.lit("- "), F.concat_ws(" | ", "subject", "relation", "object"))
    return edges.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n").alias("facts"))
