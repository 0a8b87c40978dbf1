"""Offline backends: deterministic stand-ins for models.

generation: ``(system, prompt) -> text``; embedding: ``(texts, kind) -> vectors``;
rerank: ``(queries, passages) -> scores``; all over pandas Series.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from larkspur.registry import backends

#: Words that carry no content.
STOPWORDS = ["the", "a", "an", "is", "are", "was", "were", "be", "of", "to", "in", "on", "at", "for", "and", "or", "with", "as", "by", "it", "its", "that", "this", "from", "what", "how", "do", "does", "within", "you", "your", "may", "can", "will", "i", "we", "my"]
_WORD = re.compile(r"\w+")
DIMS = 64


def hashing_vectors(texts: pd.Series, kind: str = "document", dims: int = DIMS) -> pd.Series:
    """Bags of words hashed to signed dimensions, of length 1 (zero for empty texts)."""
    out = []
    for text in texts.fillna(""):
        v = np.zeros(dims)
        for word in _WORD.findall(text.lower()):
            h = zlib.crc32(word.encode())
            v[h % dims] += 1.0 if h >> 31 else -1.0
        size = np.linalg.norm(v)
        out.append((v / size if size else v).tolist())
    return pd.Series(out)


def overlap_scores(queries: pd.Series, passages: pd.Series) -> pd.Series:
    """Share of the query's content words that the passage has."""
    out = []
    for q, p in zip(queries.fillna(""), passages.fillna("")):
        words = set(_WORD.findall(q.lower())) - set(STOPWORDS)
        out.append(len(words & set(_WORD.findall(p.lower()))) / len(words) if words else 0.0)
    return pd.Series(out, dtype="float64")


def echo(system: pd.Series, prompt: pd.Series) -> pd.Series:
    """The prompt's last line: a text to continue from when there is no model."""
    return prompt.fillna("").map(lambda p: p.strip().splitlines()[-1] if p.strip() else "")


backends.register("embedding", "hashing", hashing_vectors)
backends.register("rerank", "overlap", overlap_scores)
backends.register("generation", "echo", echo)


def embed(text: Column, provider: str = "hashing", kind: str = "document", instruction: str = "") -> Column:
    """Vectors of texts; the instruction goes before queries only."""
    backend = backends.get("embedding", provider)

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return backend(texts, kind)

    return run(F.concat(F.lit(instruction), text) if kind == "query" and instruction else text)


def generate(system: Column, prompt: Column, provider: str = "echo") -> Column:
    backend = backends.get("generation", provider)

    @F.pandas_udf("string")
    def run(s: pd.Series, p: pd.Series) -> pd.Series:
        return backend(s, p)

    return run(system, prompt)


def rerank_score(query: Column, passage: Column, provider: str = "overlap") -> Column:
    backend = backends.get("rerank", provider)

    @F.pandas_udf("double")
    def run(q: pd.Series, p: pd.Series) -> pd.Series:
        return backend(q, p)

    return run(query, passage)
