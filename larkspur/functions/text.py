"""Text scalars: tokens, sentences, and the small formats that models are prompted with."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TOKEN = r"[\p{L}\p{N}_]+"
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
ABSTENTION = "I don't have enough information to answer that."
#: Legal forms that end a name without being part of it.
LEGAL_SUFFIXES = ["inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "llc", "llp", "lp", "plc", "gmbh", "ag", "sa", "nv", "bv", "pty", "pte", "srl", "spa"]


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores; empty for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def strip(text: Column) -> Column:
    """Without white space (as Unicode has it) at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def word_count(text: Column) -> Column:
    """Runs of anything but white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0))


def atoms(text: Column) -> Column:
    """Sentences, within paragraphs parted by a blank line."""
    parts = F.split(text, r"\n\n|(?<=[.!?])(?U:\s)+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def normalize_name(name: Column) -> Column:
    """Lower case, no punctuation, single spaces, no legal form at the end."""
    s = F.regexp_replace(F.replace(F.lower(name), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}_]+", " ")
    return F.trim(F.regexp_replace(F.trim(s), rf"(^|\s)({'|'.join(LEGAL_SUFFIXES)})(\s+({'|'.join(LEGAL_SUFFIXES)}))*$", ""))


def citations(text: Column) -> Column:
    """Distinct numbers in square brackets, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda n: n.cast("int"))))


def abstains(text: Column) -> Column:
    return F.contains(F.lower(text), F.lit(ABSTENTION.lower().rstrip(".")))


def number_passages(passages: Column, separator: str = "\n\n", empty: str = "") -> Column:
    numbered = F.transform(passages, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p))
    return F.when(F.size(passages) > 0, F.array_join(numbered, separator)).otherwise(F.lit(empty))


def list_lines(text: Column) -> Column:
    """Lines without bullets or numbering and without blank ones."""
    bare = F.transform(F.split(text, r"\r\n|\n|\r"), lambda s: strip(F.regexp_replace(s, r"^\s*(?:[-*•]|\d+[.)])\s*", "")))
    return F.filter(bare, lambda s: s != "")


def dashed_lines(text: Column, whole: Column) -> Column:
    """Lines without surrounding dashes, stars and blanks; ``whole`` alone if there is none."""
    bare = F.filter(F.transform(F.split(text, r"\r\n|\n|\r"), lambda s: F.regexp_replace(s, r"^[ \-*\t]+|[ \-*\t]+$", "")), lambda s: s != "")
    return F.when(F.size(bare) > 0, bare).otherwise(F.array(whole))


def triple_lines(text: Column) -> Column:
    """array<struct(subject, relation, object)> of the lines with three fields between bars."""
    lines = F.transform(F.split(text, r"\r\n|\n|\r"), lambda s: strip(F.regexp_replace(strip(s), r"^[-*]+", "")))
    fields = F.transform(F.filter(lines, lambda s: F.regexp_count(s, F.lit(r"\|")) == 2), lambda s: F.transform(F.split(s, r"\|"), strip))
    header = F.array(F.lit("object"), F.lit("relation"), F.lit("subject"))
    good = F.filter(fields, lambda f: ~F.exists(f, lambda x: x == "") & (F.array_sort(F.transform(f, lambda x: F.lower(x))) != header))
    return F.transform(good, lambda f: F.struct(F.get(f, F.lit(0)).alias("subject"), F.get(f, F.lit(1)).alias("relation"), F.get(f, F.lit(2)).alias("object")))


def ranked_order(reply: Column, n: Column) -> Column:
    """0-based positions from a reply that lists 1-based numbers; what it leaves out follows in order."""
    said = F.transform(F.regexp_extract_all(reply, F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("int") - 1)
    valid = F.array_distinct(F.filter(said, lambda i: i.isNotNull() & (i >= 0) & (i < n)))
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.concat(valid, F.array_except(every, valid))


def stable_prefix(system: Column, tools: Column) -> Column:
    """The parts of a prompt that don't change, in order, without empty ones."""
    parts = F.concat(F.array(system), F.coalesce(tools, F.array().cast("array<string>")))
    return F.array_join(F.filter(F.transform(parts, strip), lambda s: s != ""), "\n\n")
