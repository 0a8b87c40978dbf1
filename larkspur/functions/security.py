"""Redaction of personal data, screening for injected instructions, access trimming."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Kinds of personal data and their patterns, in the order of redaction.
PII_PATTERNS = [
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("SSN", r"\b\d{3}[-\s]\d{2}[-\s]\d{4}\b"),
    ("CREDIT_CARD", r"\b(?:\d[ -]?){13,16}\b"),
    ("PHONE", r"\b(?:\+?\d{1,3}[-.\s]?)?(?:\(?\d{2,4}\)?[-.\s]?){2,4}\d{2,4}\b"),
    ("IPV4", r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"),
]
#: Weights and patterns of injected instructions.
INJECTION_PATTERNS = [
    (0.6, r"(?i)\bignore\s+(?:all\s+|the\s+)?(?:previous|prior|above|earlier)\b"),
    (0.6, r"(?i)\bdisregard\s+(?:all\s+|the\s+|your\s+|any\s+)?\w*\s*instruction"),
    (0.5, r"(?i)\b(?:forget|override)\s+(?:all\s+|the\s+|your\s+|previous\s+)"),
    (0.5, r"(?i)\bsystem\s+prompt\b"),
    (0.5, r"(?i)\byou\s+are\s+now\b"),
    (0.4, r"(?i)\b(?:act|behave)\s+as\b"),
    (0.4, r"(?i)\bnew\s+instructions?\b"),
    (0.4, r"(?i)\b(?:reveal|print|repeat|leak|exfiltrate)\s+(?:the\s+|your\s+)?(?:system\s+prompt|prompt|instructions|secret|api[\s_-]?key)"),
    (0.3, r"(?i)</?(?:system|assistant|user|instruction)\b"),
    (0.3, r"\bdo\s+anything\s+now\b|\bDAN\b"),
]


def redact(text: Column, patterns: list[tuple[str, str]] = PII_PATTERNS) -> tuple[Column, Column]:
    """The text with each kind replaced in turn, and the kinds found, both as columns.

    A later pattern sees the text as earlier ones have left it.
    """
    clean, found = text, []
    for kind, pattern in patterns:
        found.append(F.when(F.regexp_like(clean, F.lit(pattern)), F.lit(kind)))
        clean = F.regexp_replace(clean, pattern, f"[REDACTED:{kind}]")
    return clean, F.filter(F.array(*found), lambda k: k.isNotNull())


def injection(text: Column, patterns: list[tuple[float, str]] = INJECTION_PATTERNS) -> tuple[Column, Column]:
    """Risk from 0 to 1, and the first match of each pattern that hits."""
    risk, matched = F.lit(0.0), []
    for weight, pattern in patterns:
        hit = F.regexp_like(text, F.lit(pattern))
        risk = risk + F.when(hit, weight).otherwise(0.0)
        matched.append(F.when(hit, F.regexp_extract(text, pattern, 0)))
    return F.least(F.lit(1.0), risk), F.filter(F.array(*matched), lambda m: m.isNotNull())


def is_suspicious(text: Column, threshold: float = 0.5) -> Column:
    return injection(text)[0] >= threshold - 1e-9


def may_read(allowed_groups: Column, caller_groups: list[str]) -> Column:
    """True where the caller shares a group; rows without groups and callers without groups read nothing."""
    if not caller_groups:
        return F.lit(False)
    return F.coalesce(F.arrays_overlap(allowed_groups, F.array(*[F.lit(g) for g in caller_groups])), F.lit(False))
