"""Benchmark decontamination by BM25 retrieval with block-max WAND.

The test items are indexed; every passage of every training text (windows of 64
words, half overlapping) is a query against them.  Scores are divided by what an
item scores against itself (or against as much of it as a window holds), so 1
means all of it.  All items above a threshold are retrieved.  Block maxima come
in two grains: of 64 stretches of items, summed up for all passages of a batch
by array operations, which leaves few passages that can reach the threshold at
all; and of 16 postings, by which block-max WAND walks the lists for those.
Retrieved items are verified on the whole text: the shares of the words of the
item's question (first half) and answer (second half) that lie in runs of four
words that the text has too.

Both sides' words are those of one function: lower case by code point (final sigma
as sigma), runs of letters, marks, digits and underscores, and each Han, Hiragana,
Katakana, Thai, Lao, Khmer or Myanmar character a word of its own.

The index is built in shards of ``MOST_POSTINGS`` words by the executors, under
the statistics of all items, and kept in the shared folder.  The driver holds one
shard at a time, to send it out; each shard takes a pass over the texts.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from larkspur.llm.bytewise import PLAIN_WORDS, Words, shingle_hashes, slices, text_buffers
from larkspur.llm.frames import cut, small_batches

K1, B = 1.5, 0.75
WINDOW, STRIDE = 64, 32
THRESHOLD = 0.4
RUN = 4
OVERLAP = 0.5
POSTING_BLOCK = 16
#: Stretches of items with a bound of their own; words of items in one index (its bounds take 256 bytes a term).
STRETCHES = 64
MOST_POSTINGS = 2_000_000
#: Postings that a worker keeps as lists for walking.
LISTED_POSTINGS = 1 << 19
SEARCH_BYTES = 1 << 19

_NO_WORD = r"[^\x00-\x7F\p{L}\p{M}\p{N}]+"
_SYLLABLES = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"


def plain_text(texts: pa.Array) -> pa.Array:
    """Texts in lower case, in which spaces stand for non-ASCII signs and around characters that are words."""
    low = pc.utf8_lower(texts)
    if pc.all(pc.string_is_ascii(low)).as_py() is not False:
        return low
    low = pc.replace_substring(low, "\u03c2", "\u03c3")
    return pc.replace_substring_regex(pc.replace_substring_regex(low, _NO_WORD, " "), _SYLLABLES, r" \1 ")


def text_words(texts: list[str | None]) -> list[np.ndarray]:
    """Hashes of the words of each text."""
    raw, offsets = text_buffers(plain_text(pa.array([t or "" for t in texts], pa.large_string())))
    words = Words(raw, offsets, PLAIN_WORDS)
    return [words.hashes[a:b] for a, b in zip(words.first[:-1], words.first[1:])]


class ItemIndex:
    """Posting lists, their block maxima, and what verification needs, for some of the items.

    ``df_terms`` (sorted) and ``df_counts`` tell in how many of all ``n`` items a
    term occurs, for the terms of these items at least.
    """

    def __init__(self, ids: list[int], words: list[np.ndarray], df_terms: np.ndarray, df_counts: np.ndarray, n: int, mean_length: float):
        self.ids = ids
        self.runs, postings = [], []
        for i, w in enumerate(words):
            terms, tf = np.unique(w, return_counts=True)
            dfs = df_counts[np.searchsorted(df_terms, terms)].astype(float)
            idf = np.log((n - dfs + 0.5) / (dfs + 0.5) + 1)
            impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean_length))
            norm = impact.sum() * min(1.0, 1.5 * STRIDE / len(w))
            postings.append((terms, np.full(len(terms), i, np.int32), impact / norm))
            self.runs.append(shingle_hashes(w, min(RUN, len(w))))
        self.lengths = [len(w) for w in words]
        term, item, score = (np.concatenate(x) for x in zip(*postings))
        order = np.lexsort((item, term))
        self.docs, self.scores = item[order], score[order]
        self.terms, begin = np.unique(term[order], return_index=True)
        self.begin = np.r_[begin, len(order)]
        self.most = np.maximum.reduceat(self.scores, begin)
        slot = np.repeat(np.arange(len(self.terms)), np.diff(self.begin))
        self.stretch_max = np.zeros((len(self.terms), STRETCHES), np.float32)
        np.maximum.at(self.stretch_max, (slot, self.docs.astype(np.int64) * STRETCHES // len(ids)), self.scores.astype(np.float32))
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.terms & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.listed: dict[int, tuple] = {}
        self.held = 0

    def __getstate__(self) -> dict:
        return self.__dict__ | {"listed": {}, "held": 0}

    def lists(self, t: int) -> tuple[list[int], list[float], list[float], list[int]]:
        """Items, scores, and each block's greatest score and last item, of term number ``t``."""
        found = self.listed.get(t)
        if found is None:
            a, b = int(self.begin[t]), int(self.begin[t + 1])
            if self.held + b - a > LISTED_POSTINGS:
                self.listed, self.held = {}, 0
            docs, scores = self.docs[a:b], self.scores[a:b]
            blocks = np.arange(0, b - a, POSTING_BLOCK)
            last = np.minimum(blocks + POSTING_BLOCK, b - a) - 1
            found = self.listed[t] = (docs.tolist(), scores.tolist(), np.maximum.reduceat(scores, blocks).tolist(), docs[last].tolist())
            self.held += b - a
        return found

    def wand(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items that score at least ``threshold`` for the distinct terms."""
        end = len(self.ids)
        at = [0] * len(terms)
        blk = [0] * len(terms)
        lists = list(range(len(terms)))
        walked = [self.lists(t) for t in terms]
        found = []

        def seek(j: int, item: int) -> None:
            docs, _, _, block_end = walked[j]
            while blk[j] < len(block_end) and block_end[blk[j]] < item:
                blk[j] += 1
            at[j] = max(at[j], blk[j] * POSTING_BLOCK)
            while at[j] < len(docs) and docs[at[j]] < item:
                at[j] += 1

        def here(j: int) -> int:
            docs = walked[j][0]
            return docs[at[j]] if at[j] < len(docs) else end

        while True:
            lists = [j for j in lists if here(j) < end]
            lists.sort(key=here)
            bound, pivot = 0.0, -1
            for k, j in enumerate(lists):
                bound += self.most[terms[j]]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = here(lists[pivot])
            while pivot + 1 < len(lists) and here(lists[pivot + 1]) == item:
                pivot += 1
            near, block_bound, next_end = lists[: pivot + 1], 0.0, end
            for j in near:
                _, _, block_max, block_end = walked[j]
                b = blk[j]
                while b < len(block_end) and block_end[b] < item:
                    b += 1
                if b < len(block_end):
                    block_bound += block_max[b]
                    next_end = min(next_end, block_end[b] + 1)
            if block_bound < threshold:
                skip = min([next_end] + [here(j) for j in lists[pivot + 1 : pivot + 2]])
                for j in near:
                    seek(j, max(skip, item + 1))
                continue
            for j in near:
                seek(j, item)
            score = sum(walked[j][1][at[j]] for j in near if here(j) == item)
            if score >= threshold:
                found.append((item, score))
            for j in near:
                seek(j, item + 1)

    def overlaps(self, item: int, present: np.ndarray) -> tuple[float, float]:
        """Shares of the question's and the answer's words inside runs that are present."""
        runs, n = self.runs[item], self.lengths[item]
        covered = np.zeros(n, bool)
        for start in np.flatnonzero(np.isin(runs, present)).tolist():
            covered[start : start + min(RUN, n)] = True
        half = (n + 1) // 2
        return float(covered[:half].mean()), float(covered[half:].mean()) if n > 1 else float(covered[0])

    def search(self, words: Words) -> list[tuple[int, int, float, float, float]]:
        """(text, item, score, question overlap, answer overlap) of all verified items."""
        h, first = words.hashes, words.first
        if not len(h) or not len(self.terms):
            return []
        maybe = np.flatnonzero(self.filter[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        slot = np.searchsorted(self.terms, h[maybe])
        slot[slot == len(self.terms)] = 0
        known = self.terms[slot] == h[maybe]
        at, term = maybe[known], slot[known]
        if not len(at):
            return []
        # Windows of the texts: each hit is in one or two; in a window a term counts where it comes first.
        counts = np.diff(first)
        windows = np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1) * (counts > 0)
        base = np.cumsum(windows) - windows
        text = np.searchsorted(first, at, side="right") - 1
        inside = at - first[text]
        order = np.lexsort((at, term, text))
        again = (np.diff(term[order]) == 0) & (np.diff(text[order]) == 0)
        before = np.full(len(at), -1)
        before[order[1:][again]] = inside[order[:-1][again]]
        late = np.minimum(inside // STRIDE, windows[text] - 1)
        early = np.maximum(-(-(inside - WINDOW + 1) // STRIDE), 0)
        window, hit = np.r_[base[text] + late, base[text] + early], np.r_[np.arange(len(at)), np.arange(len(at))]
        nth = np.r_[late, early]
        fresh = (before[hit] < nth * STRIDE) & np.r_[np.ones(len(at), bool), early < late]
        window, hit = window[fresh], hit[fresh]
        order = np.argsort(window, kind="stable")
        window, hit = window[order], hit[order]
        begin = np.flatnonzero(np.r_[True, window[1:] != window[:-1]])
        bounds = np.add.reduceat(self.stretch_max[term[hit]], begin, axis=0).max(axis=1)
        best: dict[tuple[int, int], float] = {}
        ends = np.r_[begin[1:], len(hit)]
        for w in np.flatnonzero(bounds >= THRESHOLD - 1e-4).tolist():
            mine = hit[begin[w] : ends[w]]
            for item, score in self.wand(np.sort(term[mine]).tolist(), THRESHOLD):
                key = (int(text[mine[0]]), item)
                best[key] = max(score, best.get(key, 0.0))
        out, present, last = [], np.empty(0, np.uint64), -1
        for (row, item), score in sorted(best.items()):
            mine = h[first[row] : first[row + 1]]
            if row != last:
                present, last = shingle_hashes(mine, RUN), row
            runs = present if self.lengths[item] >= RUN else shingle_hashes(mine, self.lengths[item])
            question, answer = self.overlaps(item, runs)
            if question >= OVERLAP and answer >= OVERLAP:
                out.append((row, item, score, question, answer))
        return out


def item_shards(benchmark: DataFrame, id_column: str = "item_id", most: int | None = None) -> DataFrame:
    """shard, data: pickled indexes over all items with words, each of about ``most`` words unless one item has more.

    Of null ids and texts none is indexed, and an id that comes again is indexed
    again.  Words are counted, joined with their counts over all items, and put
    together by shard; no step gathers more than a shard in one place.
    """
    most = most or MOST_POSTINGS

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [w.view(np.int64) for w in text_words(batch.column(1).to_pylist())]
            some = [i for i, w in enumerate(words) if len(w)]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0).take(pa.array(some, pa.int64())), "words": pa.array([words[i] for i in some], pa.list_(pa.int64()))})

    rows = benchmark.select(F.col(id_column).cast("long").alias("id"), F.col("text").cast("string").alias("text")).filter("id is not null and text is not null")
    items = cut(small_batches(rows).mapInArrow(split, "id long, words array<long>"))
    n, length = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    shards = max(1, -(-length // most))
    keyed = items.withColumn("shard", F.pmod(F.xxhash64("id", "words"), F.lit(shards)).cast("int"))
    terms = keyed.select("shard", F.explode(F.array_distinct("words")).alias("term")).groupBy("term", "shard").agg(F.count(F.lit(1)).alias("n"))
    df = terms.groupBy("term").agg(F.sum("n").alias("df"))
    terms = terms.select("term", F.col("shard").alias("place")).join(df.hint("merge"), "term")

    def build(mine: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        if mine.empty:
            return pd.DataFrame({"shard": pd.Series(dtype="int32"), "data": pd.Series(dtype=object)})
        mine = mine.sort_values("id", kind="stable")
        term = counts["term"].to_numpy().view(np.uint64)
        order = np.argsort(term)
        index = ItemIndex(mine["id"].tolist(), [np.asarray(w, np.int64).view(np.uint64) for w in mine["words"]], term[order], counts["df"].to_numpy()[order], n, length / n)
        return pd.DataFrame({"shard": [int(mine["shard"].iloc[0])], "data": [pickle.dumps(index)]})

    return cut(keyed.groupBy("shard").cogroup(terms.groupBy("place")).applyInPandas(build, "shard int, data binary"))


def item_indexes(benchmark: DataFrame, id_column: str = "item_id", most: int | None = None) -> Iterator[ItemIndex]:
    """The indexes of ``item_shards`` one after the other."""
    shards = item_shards(benchmark, id_column, most)
    for (shard,) in shards.select("shard").orderBy("shard").collect():
        yield pickle.loads(shards.filter(F.col("shard") == shard).first()["data"])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "item_id") -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: one row per text and item it holds.

    ``docs`` has doc_id and text; null and empty texts hold nothing; a row that
    comes twice is reported twice; a null doc_id is reported as null.  Empty
    tables give an empty result.  Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    out = spark.createDataFrame([], schema)
    for index in item_indexes(benchmark, id_column):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                column = batch.column(1)
                _, offsets = text_buffers(column)
                found = []
                for a, b in slices(offsets, SEARCH_BYTES):
                    ids = batch.column(0).slice(a, b - a)
                    raw, ends = text_buffers(plain_text(column.slice(a, b - a)))
                    for text, item, *scores in index.search(Words(raw, ends, PLAIN_WORDS)):
                        found.append((ids[text].as_py(), index.ids[item], *scores))
                if found:
                    columns = list(zip(*found))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:2]] + [pa.array(c, pa.float64()) for c in columns[2:]], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_column: str = "item_id") -> DataFrame:
    """The rows of ``docs`` whose text holds no item, in one pass per index and without a shuffle.

    Rows with a null doc_id, or with a null or empty text, are kept like any
    others; a row that repeats stays or goes as often as it comes.  All columns,
    whatever their names, stay as they are.  An empty table gives an empty one,
    and without items every row stays.
    """
    spark = docs.sparkSession
    out = small_batches(docs)
    for index in item_indexes(benchmark, id_column):
        shared = spark.sparkContext.broadcast(index)
        place = out.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], shared=shared, place=place) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column(place)
                _, offsets = text_buffers(column)
                keep = np.ones(batch.num_rows, bool)
                for a, b in slices(offsets, SEARCH_BYTES):
                    raw, ends = text_buffers(plain_text(column.slice(a, b - a)))
                    for text, *_ in shared.value.search(Words(raw, ends, PLAIN_WORDS)):
                        keep[a + text] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, out.schema)
    return out


def contamination_report(docs: DataFrame, benchmark: DataFrame, id_column: str = "item_id") -> DataFrame:
    """``contaminated`` with its numbers rounded to 6 places."""
    found = contaminated(docs, benchmark, id_column)
    return found.select("doc_id", "item_id", *[F.round(c, 6).alias(c) for c in ("score", "question_overlap", "answer_overlap")])


def _words_sql(text: str) -> str:
    return rf"regexp_extract_all(replace(lower({text}), 'ς', 'σ'), '[\p{{L}}\p{{M}}\p{{N}}_]+')"


#: ``contamination_report`` of documents and benchmark, by all windows and all items; of scripts that part words by spaces.
CONTAMINATION_SQL = rf"""
WITH items AS (SELECT i, item_id, w, len(w) AS n FROM (SELECT row_number() OVER () AS i, item_id, {_words_sql('text')} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL) WHERE len(w) > 0),
stats AS (SELECT count(*) AS n_items, avg(n) AS mean FROM items),
tf AS (SELECT i, n, t, count(*) AS tf FROM (SELECT i, n, unnest(w) AS t FROM items) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
impact AS (SELECT i, n, t, ln((n_items - df + 0.5) / (df + 0.5) + 1) * tf * ({K1} + 1) / (tf + {K1} * (1 - {B} + {B} * n / mean)) AS x FROM tf JOIN df USING (t) CROSS JOIN stats),
norms AS (SELECT i, sum(x) * least(1.0, 1.5 * {STRIDE} / any_value(n)) AS norm FROM impact GROUP BY i),
docs AS (SELECT row_number() OVER () AS d, doc_id, {_words_sql('text')} AS w FROM documents WHERE text IS NOT NULL),
places AS (SELECT d, greatest(1, (len(w) - {WINDOW} + {STRIDE - 1}) // {STRIDE} + 1) AS windows, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS place FROM docs),
held AS (SELECT DISTINCT d, t, unnest(range(greatest(0, (place - {WINDOW - 1} + {STRIDE - 1}) // {STRIDE}), least(place // {STRIDE}, windows - 1) + 1)) AS k FROM places WHERE t IN (SELECT t FROM df)),
scores AS (SELECT d, k, i, sum(x) / any_value(norm) AS score FROM held JOIN impact USING (t) JOIN norms USING (i) GROUP BY d, k, i),
best AS (SELECT d, i, max(score) AS score FROM scores GROUP BY ALL HAVING max(score) >= {THRESHOLD}),
pairs AS (SELECT doc_id, item_id, score, i.w, n, least({RUN}, n) AS r, ' ' || array_to_string(docs.w, ' ') || ' ' AS txt FROM best JOIN items i USING (i) JOIN docs USING (d)),
runs AS (SELECT *, list_filter(range(n - r + 1), lambda j: contains(txt, ' ' || array_to_string(w[j + 1:j + r], ' ') || ' ')) AS js FROM pairs),
covered AS (SELECT *, (n + 1) // 2 AS half, list_transform(range(n), lambda p: (len(list_filter(js, lambda j: j <= p AND p < j + r)) > 0)::INT) AS c FROM runs),
shares AS (SELECT doc_id, item_id, score, list_sum(c[1:half])::DOUBLE / half AS question, CASE WHEN n > 1 THEN list_sum(c[half + 1:n])::DOUBLE / (n - half) ELSE c[1]::DOUBLE END AS answer FROM covered)
SELECT doc_id, item_id, round(score, 6)::DOUBLE AS score, round(question, 6)::DOUBLE AS question_overlap, round(answer, 6)::DOUBLE AS answer_overlap FROM shares WHERE question >= {OVERLAP} AND answer >= {OVERLAP}
"""
