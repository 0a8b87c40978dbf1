"""Record types: chunks, judgments and the columns of rankings."""

from __future__ import annotations

from pyspark.sql import Column, types as T, functions as F

CHUNK = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
        T.StructField("doc_id", T.StringType(), False),
        T.StructField("section_path", T.ArrayType(T.StringType())),
        T.StructField("page", T.IntegerType()),
        T.StructField("date", T.StringType()),
        T.StructField("allowed_groups", T.ArrayType(T.StringType())),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    ]
)
CORPUS = "id string, title string, text string"
GOLDEN = "query string, relevant array<string>, gains map<string,double>, reference_answer string, note string"
RANKING = ["query_id", "doc_id", "score", "rank"]


def with_context(text: Column, tags: Column, prefix: Column) -> tuple[Column, Column]:
    """The text behind a prefix and a blank line, and tags that keep the original text."""
    kept = F.map_filter(F.coalesce(tags, F.create_map().cast("map<string,string>")), lambda k, _: k != "original_text")
    return F.concat(prefix, F.lit("\n\n"), text), F.map_concat(kept, F.create_map(F.lit("original_text"), text))
