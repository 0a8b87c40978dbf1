"""Heuristic query routing as expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from larkspur.functions.text import TOKEN, strip, word_count

#: Cue words and patterns of the routers.
MULTI_HOP_MARKERS = ["and then", "compare", "comparison", "difference between", "versus", " vs ", "vs.", "relationship between", "both", "each of", "as well as", "after which", "before that", "trace the", "step by step"]
QUESTION_WORDS = ["who", "what", "when", "where", "which", "why", "how", "whom", "whose"]
NO_RETRIEVAL_CUES = ["hello", "hi there", "thank you", "thanks", "good morning", "how are you", "who are you", "what can you do", "tell me a joke"]
COUNTED_QUESTION_WORDS = ["what", "who", "when", "where", "how", "why"]
ENTITY = r"\b[A-Z][a-zA-Z0-9]+\b"
NO_RETRIEVAL_PATTERN = r"(?i)\b(what is|what are|define|definition of|who wrote|capital of|how many|convert|translate|spell|meaning of)\b"
MULTI_HOP_PATTERN = r"(?i)\b(compare|difference between|relationship between|how does .* (affect|relate|impact)|both|and then|after that|step by step|which .* and .*|trace|chain|connected to|exposed to|across (all|these|the))\b"
COMPOSITIONAL_CUES = [" and ", " same ", " compared", " than ", " both ", " which of ", " each ", "headquarter", "largest", "most ", "least ", " versus ", " vs "]
REASONING_CUES = ["why", "how", "compare", "contrast", "explain", "analyze", "analyse", "trade-off", "tradeoff", "implications", "step by step", "step-by-step", "difference between", "pros and cons", "evaluate", "derive", "prove"]
STEP_COST = {"no_retrieval": 0, "single": 1, "multi": 3}


def _any(text: Column, cues: list[str]) -> Column:
    hit = F.lit(False)
    for cue in cues:
        hit = hit | F.contains(text, F.lit(cue))
    return hit


def _occurrences(text: Column, part: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / F.lit(len(part))


def complexity_class(query: Column, entity_threshold: int = 2) -> Column:
    """no_retrieval, single or multi by surface cues; doubt goes towards more retrieval."""
    q = strip(query)
    low = F.lower(q)
    words = F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0))
    asks = F.endswith(low, F.lit("?")) | F.exists(words, lambda w: w.isin(QUESTION_WORDS))
    names = F.array_distinct(F.transform(F.regexp_extract_all(q, F.lit(ENTITY), F.lit(0)), lambda e: F.lower(e)))
    joins = _occurrences(low, " and ") + _occurrences(low, ";") + _occurrences(low, " as well as ")
    questions = sum((_occurrences(low, w) for w in COUNTED_QUESTION_WORDS), F.lit(0.0))
    return (
        F.when(q == "", "no_retrieval")
        .when((F.size(words) <= 6) & ~asks & _any(low, NO_RETRIEVAL_CUES), "no_retrieval")
        .when(_any(low, MULTI_HOP_MARKERS), "multi")
        .when(F.size(names) >= entity_threshold, "multi")
        .when((joins >= 1) & (questions >= 2), "multi")
        .otherwise("single")
    )


def adaptive_route(query: Column) -> Column:
    """no_retrieval, single or multi, where cues of several hops come first."""
    q = strip(query)
    return F.when(F.regexp_like(q, F.lit(MULTI_HOP_PATTERN)), "multi").when(F.regexp_like(q, F.lit(NO_RETRIEVAL_PATTERN)), "no_retrieval").otherwise("single")


def is_compositional(query: Column) -> Column:
    return _any(F.lower(query), COMPOSITIONAL_CUES) | (word_count(query) > 18)


def model_complexity(query: Column) -> Column:
    low, n = F.lower(query), word_count(query)
    score = F.when(n > 25, 1.0).when(n > 12, 0.5).otherwise(0.0)
    score = score + F.when(_occurrences(query, "?") > 1, 0.5).otherwise(0.0)
    score = score + F.when(F.contains(low, F.lit(" and ")) | F.contains(query, F.lit("; ")), 0.25).otherwise(0.0)
    for cue in REASONING_CUES:
        score = score + F.when(F.contains(low, F.lit(cue)), 0.6).otherwise(0.0)
    return score


def model_route(query: Column, threshold: float = 1.0, cheap: str = "cheap", strong: str = "strong") -> Column:
    return F.when(model_complexity(query) >= threshold - 1e-9, strong).otherwise(cheap)


def step_cost(route: Column) -> Column:
    return F.when(route == "no_retrieval", STEP_COST["no_retrieval"]).when(route == "single", STEP_COST["single"]).otherwise(STEP_COST["multi"])
