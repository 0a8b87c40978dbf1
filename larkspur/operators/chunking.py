"""Chunking: greedy packing of sentences with an overlap of whole sentences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from larkspur.functions.text import atoms
from larkspur.schema import CHUNK

STRATEGIES = ("recursive",)


def spans(sizes: list[int], target: int, overlap: int) -> list[tuple[int, int]]:
    """Begin and end of chunks of sentences with so many words: at most ``target`` words where sentences allow it.

    A chunk is closed when the next sentence would overflow it.  The next chunk
    begins with the longest run of its last sentences of at most ``overlap`` words,
    and takes its next sentence whatever the sum.
    """
    out: list[tuple[int, int]] = []
    begin, words = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and words + n > target:
            out.append((begin, i))
            closed, begin, words = begin, i, 0
            while begin > closed and words + sizes[begin - 1] <= overlap:
                begin -= 1
                words += sizes[begin]
        words += n
    if sizes:
        out.append((begin, len(sizes)))
    return out


def pack(sentences: list[str], target: int, overlap: int) -> list[str]:
    """The texts of chunks."""
    return [" ".join(sentences[a:b]) for a, b in spans([len(s.split()) for s in sentences], target, overlap)]


def chunk_terms(batch: pa.RecordBatch, terms: pa.Array, targets: tuple[int, ...], overlap: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Chunk ids and each chunk's tokens, as their numbers among ``terms`` (-1: none), for each size of a batch (doc_id, atoms, tokens of each atom).

    No token reaches over the space between two sentences, so a chunk's tokens are
    those of its sentences.
    """
    tokens = batch.column(2)
    outer = tokens.offsets.to_numpy()
    inner = tokens.values.offsets.to_numpy()[outer[0] : outer[-1] + 1].astype(np.int64)
    number = pc.index_in(tokens.values.values.slice(inner[0], inner[-1] - inner[0]), value_set=terms).fill_null(-1).to_numpy()
    inner -= inner[0]
    sizes = [[len(s.split()) for s in a or []] for a in batch.column(1).to_pylist()]
    first = np.cumsum([0, *map(len, sizes)])
    for target in targets:
        made = [spans(s, target, overlap) for s in sizes]
        many = np.array([len(m) for m in made], np.int64)
        doc = np.repeat(np.arange(len(made)), many)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
        edges = np.array([e for m in made for e in m], np.int64).reshape(-1, 2) + first[doc][:, None]
        begin, length = inner[edges[:, 0]], inner[edges[:, 1]] - inner[edges[:, 0]]
        ends = np.r_[0, np.cumsum(length)]
        at = np.repeat(begin - ends[:-1], length) + np.arange(ends[-1])
        ids = pc.binary_join_element_wise(batch.column(0).take(pa.array(doc)), pa.array(place).cast(pa.string()), "::", null_handling="skip")
        yield ids, pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(number[at]))


def chunk_documents(docs: DataFrame, target_tokens: int = 120, overlap_tokens: int = 30, strategy: str = "recursive") -> DataFrame:
    """Chunk records of (doc_id, text[, section_path]): id ``doc_id::i``, tags chunk_index and strategy."""
    if strategy not in STRATEGIES:
        raise NotImplementedError(f"chunking strategy {strategy!r}; known: {STRATEGIES}")
    if "doc_id" not in docs.columns:
        raise ValueError("documents need a doc_id")
    path = F.col("section_path") if "section_path" in docs.columns else F.lit(None).cast("array<string>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [pack(a or [], target_tokens, overlap_tokens) for a in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.string())), batch.column(2)], ["doc_id", "chunks", "section_path"])

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), atoms(F.col("text")).alias("atoms"), path.alias("section_path"))
    rows = rows.mapInArrow(run, "doc_id string, chunks array<string>, section_path array<string>")
    rows = rows.select("doc_id", "section_path", F.posexplode("chunks").alias("i", "text"))
    made = {
        "id": F.concat_ws("::", "doc_id", F.col("i").cast("string")),
        "text": F.col("text"),
        "doc_id": F.col("doc_id"),
        "section_path": F.coalesce("section_path", F.array().cast("array<string>")),
        "allowed_groups": F.array().cast("array<string>"),
        "tags": F.create_map(F.lit("chunk_index"), F.col("i").cast("string"), F.lit("strategy"), F.lit(strategy)),
    }
    return rows.select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CHUNK.fields])
