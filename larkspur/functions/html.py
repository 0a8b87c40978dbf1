"""Content types, HTML tables as Markdown, and plain text from simple HTML, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from larkspur.functions.text import strip

#: The named character references that are decoded; numeric ones are not.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&middot;", "·"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&amp;", "&")]


def sniff(text: Column) -> Column:
    """Content type of a path by its suffix, or of inline text by a leading tag."""
    low, start = F.lower(text), F.substring(F.regexp_replace(text, r"(?U)^\s+", ""), 1, 1)
    tagged = F.contains(low, F.lit("<table")) | F.contains(low, F.lit("<html")) | F.contains(low, F.lit("<body")) | F.contains(low, F.lit("<p"))
    return (
        F.when(F.endswith(low, F.lit(".pdf")), "application/pdf")
        .when(F.endswith(low, F.lit(".html")) | F.endswith(low, F.lit(".htm")), "text/html")
        .when(F.endswith(low, F.lit(".md")) | F.endswith(low, F.lit(".markdown")), "text/markdown")
        .when(F.endswith(low, F.lit(".txt")), "text/plain")
        .when((start == "<") & tagged, "text/html")
        .otherwise("text/plain")
    )


def sniff_bytes(content: Column) -> Column:
    """Content type of a file's bytes."""
    head = F.lower(F.make_valid_utf8(F.substring(content, 1, 1024).cast("string")))
    inside = F.contains(head, F.lit("<table")) | F.contains(head, F.lit("<html")) | F.contains(head, F.lit("<body"))
    starts = F.startswith(F.regexp_replace(head, r"^\s+", ""), F.lit("<"))
    return F.when(F.substring(content, 1, 5) == F.lit(b"%PDF-"), "application/pdf").when(F.coalesce(starts & inside, F.lit(False)), "text/html").otherwise("text/plain")


def unescape(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def cell_text(raw: Column) -> Column:
    text = F.replace(unescape(F.regexp_replace(raw, r"<[^>]+>", " ")), F.lit("|"), F.lit("\\|"))
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def table_markdown(html: Column) -> Column:
    """The rows of a table as Markdown; a cell that spans columns is repeated, short rows are filled up."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cell = F.lit(r"(?is)<(t[hd])\b([^>]*)>(.*?)</\1>")

    def cells(row: Column) -> Column:
        span = F.transform(F.regexp_extract_all(row, cell, F.lit(2)), lambda a: F.greatest(F.coalesce(F.regexp_extract(a, r"(?i)colspan\s*=\s*[\"']?(\d+)", 1).try_cast("int"), F.lit(1)), F.lit(1)))
        text = F.transform(F.regexp_extract_all(row, cell, F.lit(3)), cell_text)
        return F.flatten(F.transform(F.arrays_zip(text.alias("t"), span.alias("n")), lambda z: F.array_repeat(z["t"], z["n"])))

    filled = F.filter(F.transform(rows, cells), lambda r: F.size(r) > 0)
    width = F.array_max(F.transform(filled, lambda r: F.size(r)))
    lines = F.transform(filled, lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |")))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    out = F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))), "\n")
    return F.when(F.size(filled) > 0, out).otherwise(F.lit(""))


def plain_text(html: Column) -> Column:
    """Text with a line per block; tables become Markdown between blank lines."""
    tables = F.lit(r"(?is)<table\b[^>]*>.*?</table>")
    between = F.split(html, r"(?is)<table\b[^>]*>.*?</table>")
    made = F.transform(F.regexp_extract_all(html, tables, F.lit(0)), lambda t: F.concat(F.lit("\n\n"), table_markdown(t), F.lit("\n\n")))
    joined = F.array_join(F.transform(between, lambda b, i: F.concat(b, F.coalesce(F.get(made, i), F.lit("")))), "")
    text = F.regexp_replace(joined, r"(?i)</(p|div|h[1-6]|li|tr|br\s*/?)>", "\n")
    text = unescape(F.regexp_replace(text, r"<[^>]+>", ""))
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def parse(source: Column, content_type: Column | None = None) -> Column:
    """Plain text of inline HTML, or the stripped text."""
    kind = sniff(source) if content_type is None else content_type
    return F.when(kind == "text/html", plain_text(source)).otherwise(strip(source))
