"""Entity resolution against a crosswalk of names."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from larkspur.functions.text import normalize_name


def crosswalk(entities: DataFrame) -> DataFrame:
    """alias_norm, canonical_id, ord of (canonical_id, aliases, ord): ids are names of their own, the last writer wins."""
    names = entities.select("canonical_id", "ord", F.posexplode(F.concat(F.array("canonical_id"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("at", "name"))
    names = names.withColumn("alias_norm", normalize_name(F.col("name"))).filter("alias_norm <> ''")
    return names.groupBy("alias_norm").agg(F.max_by("canonical_id", F.struct("ord", "at")).alias("canonical_id"), F.min(F.struct("ord", "at")).alias("first")).select("alias_norm", "canonical_id", "first")


def similarity(a: str, b: str) -> float:
    """Ratcliff-Obershelp ratio of two names, with or without their spaces, whichever is larger."""
    return max(SequenceMatcher(None, x, y).ratio() for x, y in ((a, b), (a.replace(" ", ""), b.replace(" ", ""))))


def resolve(mentions: DataFrame, aliases: DataFrame, threshold: float = 0.85, review_low: float = 0.6, blocking: bool = True) -> DataFrame:
    """mention_id, canonical_id, method, score, matched_alias of (mention_id, name).

    Exact names are joined first; the rest meets aliases that begin with its
    first word (or all, without blocking) and takes the most similar, the earliest
    of equals.  Below ``threshold`` a match is for review, below ``review_low`` none.
    """
    if not 0 <= review_low <= threshold <= 1:
        raise ValueError("0 <= review_low <= threshold <= 1 must hold")
    m = mentions.select("mention_id", normalize_name(F.col("name")).alias("key"))
    exact = m.join(aliases.select(F.col("alias_norm").alias("key"), "canonical_id"), "key", "left")
    done = exact.filter("canonical_id is not null").select("mention_id", "canonical_id", F.lit("deterministic").alias("method"), F.lit(1.0).alias("score"), F.col("key").alias("matched_alias"))
    rest = exact.filter("canonical_id is null").select("mention_id", "key")

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(x, y) for x, y in zip(a, b)], dtype="float64")

    # A first word has no blank, so an alias begins with it if it is one of the beginnings of the alias's own first word.
    keyed = rest.filter("key <> ''").withColumn("head", F.substring_index("key", " ", 1))
    stored = aliases.select("alias_norm", F.col("canonical_id").alias("found"), "first")
    if blocking:
        word = F.substring_index("alias_norm", " ", 1)
        beginnings = F.transform(F.sequence(F.lit(1), F.length(word)), lambda n: F.substring(word, F.lit(1), n))
        pairs = keyed.join(stored.withColumn("head", F.explode(beginnings)), "head")
    else:
        pairs = keyed.crossJoin(stored)
    scored = pairs.withColumn("score", F.round(ratio("key", "alias_norm"), 9)).filter("score > 0")
    best = scored.groupBy("mention_id").agg(F.max_by(F.struct("found", "alias_norm", "score"), F.struct("score", (-F.col("first.ord")).alias("o"), (-F.col("first.at")).alias("a"))).alias("b"))
    method = F.when(F.col("b.score") >= threshold, "fuzzy").when(F.col("b.score") >= review_low, "review").otherwise("none")
    fuzzy = rest.join(best, "mention_id", "left").withColumn("method", F.coalesce(method, F.lit("none")))
    named = F.when(F.col("method").isin("fuzzy", "review"), F.col("b.found"))
    fuzzy = fuzzy.select("mention_id", named.alias("canonical_id"), "method", F.coalesce("b.score", F.lit(0.0)).alias("score"), F.when(F.col("method") != "none", F.col("b.alias_norm")).alias("matched_alias"))
    return done.unionByName(fuzzy)


def accepted(resolutions: DataFrame) -> DataFrame:
    """mention_id, canonical_id: only ids found without need of review."""
    return resolutions.select("mention_id", F.when(F.col("method").isin("deterministic", "fuzzy"), F.col("canonical_id")).alias("canonical_id"))


def resolution_accuracy(resolutions: DataFrame, truth: DataFrame) -> DataFrame:
    """n, accuracy, false_merges against truth (mention_id, expected)."""
    both = truth.join(accepted(resolutions), "mention_id", "left")
    right = F.col("canonical_id").eqNullSafe(F.col("expected"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg(right.cast("double")).alias("accuracy"), F.sum((F.col("canonical_id").isNotNull() & ~right).cast("long")).alias("false_merges"))
