"""The corpus pipeline: documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as
Parquet and read again as the next stage's ``docs``.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.llm.decontam import decontaminate
from larkspur.llm.frames import delete_path, scratch_path, table
from larkspur.llm.mixing import mix_documents
from larkspur.llm.neardup import near_duplicates
from larkspur.llm.quality import keep_good
from larkspur.llm.queries import tokenizer_file
from larkspur.llm.tokenstore import read_tokens, write_tokens


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is that of trusted text.

    Null and empty texts and those of white space go; without trusted text only
    these do.  A null language is one of its own, null doc_ids do no harm, rows
    that repeat stay or go together, and an empty table gives an empty one.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


#: Rows without a doc_id take the place of one from here on.
_FIRST_OWN = 1 << 62


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares at least 80 % of its five-word shingles: that of the smallest doc_id.

    Rows that repeat a doc_id with the same text are one document.  Rows without a
    doc_id stand after all others, those with the same text as one document.
    Texts without words are linked with nothing and stay, null ones without a
    doc_id as one.  An empty table gives an empty one.
    """
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    text = F.col("row.text").cast("string")
    number = F.coalesce(F.col("row.doc_id").cast("long"), F.lit(_FIRST_OWN) + F.pmod(F.xxhash64(F.lit("row"), text), F.lit(_FIRST_OWN)))
    keyed = own.select("row", number.alias("doc_id"), text.alias("text"))
    kept = near_duplicates(keyed.select("doc_id", "text"), shingle=5, percent=80).filter("kept").select("doc_id").distinct()
    once = keyed.select("row", "doc_id", F.xxhash64("text").alias("text_key")).join(kept.hint("merge"), "doc_id", "left_semi")
    return once.dropDuplicates(["doc_id", "text_key"]).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages.

    Null and empty texts hold none and stay, whatever their doc_id; rows that
    repeat stay or go together.  Without items every row stays; an empty table
    gives an empty one.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target weight asks for.

    A null source is one of its own; a source without words gives nothing; rows
    that repeat share out their copies; an empty table gives an empty one.
    """
    return mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in Simple-8b segments, and per document what reading them back gives.

    A null text is an empty one, of the end id alone; null doc_ids come first and
    rows that repeat are written as often as they come; an empty table gives none.
    """
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path, tokenizer_file(), end_id=2)
    return read_tokens(spark, path)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", deduplicate),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID / binary output", tokens),
]

#: A trained model and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, from the table ``documents``; a stage's rows are kept until the next has been written."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for number, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete_path(spark, before)
        before = path
    return docs
