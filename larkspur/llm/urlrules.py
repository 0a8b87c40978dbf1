"""URL filtering by host and path rules, as a sort-merge range join.

A rule fits its host, all its subdomains, and every path that starts with the
rule's.  Under the reversed host (``com.example.www``) a path prefix ``p`` is the
interval from ``p`` up to ``p`` followed by byte FF, which no UTF-8 text holds.
A URL looks its path up under each of its parent hosts that has a rule.

Intervals of one host are nested or apart.  The stack of active rules is kept as
links: each rule knows the one below it, the longest rule that begins its path,
found by a join of the beginnings of all paths with the rules.  Where an interval
starts its rule is on top, where it ends the one below it is.  URLs and these
boundaries are sorted together and every URL takes the state of the last boundary
before it.  Hosts with many URLs are split by a salt, and only their boundaries
are repeated, so that a host of a third of all URLs is no single group.  Of the
rules found under different hosts the longest wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from larkspur.llm.frames import cut, join_small

#: URLs of one host that are swept together; a host with more is split.
SWEPT = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


_TOP = "struct<rule:string,host_length:int,verdict:string>"


def rule_boundaries(rules: DataFrame) -> DataFrame:
    """host_key, at (binary) and top: the innermost rule from each boundary on, or a null rule.

    Of rules with equal host and path, block stands before allow.
    """
    one = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").filter("host is not null and verdict is not null")
    one = one.groupBy("host", "path").agg(F.max(F.struct((F.col("verdict") == "block").alias("b"), "verdict")).alias("v")).select("host", "path", F.col("v.verdict").alias("verdict"))
    one = cut(one)
    starts = F.when(F.length("path") > 0, F.transform(F.sequence(F.lit(0), F.length("path") - 1), lambda n: F.substring(F.col("path"), F.lit(1), n)))
    shorter = one.select("host", F.col("path").alias("whole"), F.explode(starts).alias("path")).join(one, ["host", "path"])
    below = shorter.groupBy("host", "whole").agg(F.max_by(F.struct("path", "verdict"), F.length("path")).alias("below")).withColumnRenamed("whole", "path")

    def top(path: str, verdict: str) -> Column:
        return F.struct(F.concat("host", path).alias("rule"), F.length("host").alias("host_length"), F.col(verdict).alias("verdict")).cast(_TOP)

    start = F.encode("path", "utf-8")
    begins = F.struct(start.alias("at"), top("path", "verdict").alias("top"))
    ends = F.struct(F.concat(start, F.lit(b"\xff")).alias("at"), F.when(F.col("below").isNotNull(), top("below.path", "below.verdict")).alias("top"))
    linked = one.join(below, ["host", "path"], "left")
    return linked.select(_reversed(F.col("host")).alias("host_key"), F.inline(F.array(begins, ends)))


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow", swept: int = SWEPT) -> DataFrame:
    """page_id, host, path, rule and verdict for every row of ``pages`` (page_id, url, ...).

    A null URL or one without ``://`` has an empty host and path and fits no
    rule.  A URL without a rule gets ``default`` and a null rule.  Repeated rows
    are returned as often as they come; other columns are ignored; an empty table
    gives an empty result, and no rules leave every URL to the default.
    """
    urls = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    bounds = cut(rule_boundaries(rules))
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(F.reverse(labels), 1, i), "."))
    asked = urls.filter("host <> ''").groupBy("host", "path").agg(F.lit(1).alias("one")).select("host", "path", F.explode(parents).alias("host_key"))
    asked = cut(join_small(asked, bounds.select("host_key").distinct(), "host_key", "left_semi"))
    salts = cut(asked.groupBy("host_key").agg(F.ceil(F.count(F.lit(1)) / swept).cast("int").alias("salts")))
    salted = join_small(asked, salts, "host_key").withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.col("salts")).cast("int"))
    probes = salted.select("host_key", "salt", F.encode("path", "utf-8").alias("at"), F.lit(1).alias("turn"), F.struct("host", "path").alias("asked"), F.lit(None).cast(f"struct<top:{_TOP}>").alias("state"))
    marks = bounds.join(salts, "host_key").select("host_key", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "at", F.lit(0).alias("turn"), F.lit(None).cast("struct<host:string,path:string>").alias("asked"), F.struct("top").alias("state"))
    sweep = Window.partitionBy("host_key", "salt").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    found = probes.unionByName(marks).withColumn("state", F.last("state", ignorenulls=True).over(sweep)).filter("asked is not null and state.top is not null")
    best = F.max(F.struct(F.length("state.top.rule").alias("length"), F.col("state.top.host_length").alias("host_length"), F.col("state.top.rule").alias("rule"), F.col("state.top.verdict").alias("verdict")))
    ruled = found.groupBy("asked").agg(best.alias("best")).select("asked.host", "asked.path", "best.rule", "best.verdict")
    out = urls.join(ruled.hint("merge"), ["host", "path"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """host, path, verdict of a list of rules, as literal rows of the plan."""
    rows = ", ".join("(" + ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in r) + ")" for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS rules(host, path, verdict)")


#: The rules of the registered query.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

VERDICTS_SQL = r"""
WITH rules(host, path, verdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
parts AS (
  SELECT row_number() OVER () AS n, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
urls AS (
  SELECT n, page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
fits AS (
  SELECT u.n, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY u.n ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
  FROM urls u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM urls u LEFT JOIN fits f ON f.n = u.n AND f.k = 1
"""
