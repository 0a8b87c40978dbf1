"""Quality by the perplexity of an interpolated modified Kneser-Ney model of word trigrams.

Tokens are runs of letters and digits (digits as 0, case kept) and runs of other
signs.  The vocabulary has the most frequent tokens of the trusted text; any other
token stands for its shape (capitals, digits, signs and so on, by length), whose
n-grams come from the rare tokens of the trusted text.  A token's number has 18
bits, so an n-gram is a whole number, its context and suffix are bits of it.

Fitting takes all trusted documents, in folds by a hash of their ids: four fifths are
counted, one fifth is held out for the thresholds.  Their ids go to every task in
batches of bounded size, so no text is shuffled to find them.
Trigrams are summed up per task and go to shards by their middle word, as sorted
arrays in which each word takes the bits of its distance (``pack_grams``).  A trigram's context and its suffix both have that word, so a
shard knows the masses of its contexts and the distinct left neighbours of its
bigrams.  Trigrams of frequent middle words are dealt out to several shards by their
last word, which keeps suffixes whole; sums of these words' contexts are put together
in a shuffle of their own.  What all shards share are totals per word and counts of
counts.  A shard keeps counts only, and computes its probabilities where they are used.

Scoring all documents is a sharded join of trigrams.  The log probability of an
interpolated model is a sum of a value per word and per pair of words, and of what the
model knows of a trigram: its own value, or else those of its context and its suffix.
So a task cuts its texts into trigrams and adds up what it knows, the words and the
most frequent trigrams, of which a bounded number is broadcast.  The others go to the
shards: each distinct trigram once per piece of about 2 MB, with the documents that
have it.
A shard returns a compressed array of sums per piece.  What is shuffled thus grows with
the corpus, no text is shuffled, and no word is a hot key.

Thresholds: per language a quantile of the held-out documents' deviation, which is
the distance of the log perplexity from the language's median, for short texts
scaled down by the square root of the length, as these vary more.  Medians and
quantiles of a language are drawn to those of all languages with the weight of
``PRIOR`` documents, so languages with few or no trusted documents need no rule of
their own.  Documents above the threshold are bad.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from larkspur.llm.bytewise import give_back, mix, slices, span_hashes, text_buffers
from larkspur.llm.frames import cut, delete_path, join_small, release, scratch_path, shuffle_width, small_batches

ORDER = 3
BITS = 18
IDS = 1 << BITS
#: Numbers of the text's start and end, of the first shape, and of the first word.
START, END, SHAPE = 0, 1, 2
SHAPES, LENGTHS = 7, (4, 8, 16)
WORD = SHAPE + SHAPES * (len(LENGTHS) + 1)
VOCABULARY = 200_000
HELD_OUT = 5
#: Ids of trusted documents that go to every task at once; more take another pass over the documents.
IDS_AT_ONCE = 1 << 20
#: Trigrams of the model that every task has; trigrams counted for one shard, repeats included.
HEAD = 400_000
SHARD_GRAMS = 1 << 20
#: Text whose n-grams are looked up together, and n-grams a task counts before it sums them up.
PIECE_BYTES = 2 << 20
COUNT_AT_ONCE = 1 << 19
#: Different numbers a task holds the sums of before it hands them on.
SUMS_AT_ONCE = 1 << 21
#: Log perplexities are put on a grid of this step for quantiles.
GRID = 0.0005
#: Tokens beyond which a text counts as long.
LONG = 100
QUANTILE, PRIOR = 0.999, 20

_KIND = np.full(256, 2, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[b for b in range(256) if b >= 0x80 or chr(b).isalnum()]] = 1
_DIGITS_AS_0 = np.arange(256, dtype=np.uint8)
_DIGITS_AS_0[ord("0") : ord("9") + 1] = ord("0")


class Tokens:
    """The tokens of a range of texts: ``hashes`` and ``shapes`` (numbers), ``first[d]:first[d + 1]`` for text ``d``."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        bounds = offsets - offsets[0]
        data = _DIGITS_AS_0[raw[offsets[0] : offsets[-1]]]
        kind, n = _KIND[data], len(data)
        turn = np.ones(n + 1, bool)
        turn[1:n] = kind[1:] != kind[:-1]
        turn[bounds] = True
        edges = np.flatnonzero(turn)
        starts, ends = edges[:-1], edges[1:]
        some = kind[starts] > 0 if n else np.empty(0, bool)
        starts, ends = starts[some], ends[some]
        self.hashes = span_hashes(data, starts, ends)
        self.first = np.searchsorted(starts, bounds)

        def count(flags: np.ndarray) -> np.ndarray:
            total = np.r_[0, np.cumsum(flags, dtype=np.int32)]
            return total[ends] - total[starts]

        lower = count((data >= ord("a")) & (data <= ord("z")))
        capital = (data >= ord("A")) & (data <= ord("Z"))
        upper, digit, size = count(capital), count(data == ord("0")), ends - starts
        first = capital[starts]
        shape = np.select([kind[starts] == 2, digit > 0, (upper > 0) & (lower == 0) & (size > 1), first & (upper == 1), upper > 0, lower > 0], range(6), 6)
        self.shapes = (SHAPE + shape * (len(LENGTHS) + 1) + np.searchsorted(LENGTHS, size)).astype(np.int32)

    def numbers(self, vocabulary: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Numbers of all tokens under a sorted vocabulary of hashes with their ranks."""
        if not len(vocabulary):
            return self.shapes
        at = np.searchsorted(vocabulary, self.hashes)
        at[at == len(vocabulary)] = 0
        return np.where(vocabulary[at] == self.hashes, WORD + ranks[at], self.shapes).astype(np.int32)


def sequences(numbers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' numbers between START twice and END; each one's text, and its place in the text.  Texts without tokens have none."""
    counts = np.diff(first)
    sizes = np.where(counts > 0, counts + ORDER, 0)
    begin = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(counts), dtype=np.int32), sizes)
    place = (np.arange(len(text)) - begin[text]).astype(np.int32)
    out = np.full(len(text), START, np.int64)
    inner = (place >= ORDER - 1) & (place < sizes[text] - 1)
    out[inner] = numbers
    out[place == sizes[text] - 1] = END
    return out, text, place


def middle_first(sequence: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The trigrams that end at these places: the middle number in the highest bits, then the first, then the last."""
    return (sequence[at - 1] << (2 * BITS)) | (sequence[at - 2] << BITS) | sequence[at]


def context_of(gram: np.ndarray) -> np.ndarray:
    """The context of trigrams, its last number first."""
    return gram >> BITS


def suffix_of(gram: np.ndarray) -> np.ndarray:
    """The bigram that ends trigrams."""
    return ((gram >> (2 * BITS)) << BITS) | (gram & (IDS - 1))


def _summed(texts: DataFrame, of, name: str) -> DataFrame:
    """name, n: how often each number of ``of(raw, offsets)`` comes in all of ``texts``, summed up per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        held: list[np.ndarray] = []
        size = 0

        def add() -> None:
            nonlocal seen, counts, held, size
            if held:
                new, n = np.unique(np.concatenate(held), return_counts=True)
                every = np.union1d(seen, new)
                total = np.zeros(len(every), np.int64)
                total[np.searchsorted(every, seen)] = counts
                total[np.searchsorted(every, new)] += n
                seen, counts, held, size = every, total, [], 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal seen, counts
            for i in range(0, len(seen), 100_000):
                yield pa.RecordBatch.from_pydict({name: pa.array(seen[i : i + 100_000], pa.int64()), "n": pa.array(counts[i : i + 100_000], pa.int64())})
            seen, counts = np.empty(0, np.int64), np.empty(0, np.int64)

        for batch in batches:
            raw, offsets = text_buffers(batch.column(0))
            for a, b in slices(offsets):
                held.append(of(raw, offsets[a : b + 1]))
                size += len(held[-1])
                if size >= COUNT_AT_ONCE:
                    add()
                    if len(seen) >= SUMS_AT_ONCE:
                        yield from out()
        add()
        yield from out()
        give_back()

    return small_batches(texts).select(F.col("text").cast("string")).mapInArrow(run, f"{name} long, n long").groupBy(name).agg(F.sum("n").alias("n"))


def _at_least(counts: DataFrame, most: int, least: int = 1) -> int:
    """The smallest count, not below ``least``, that at most ``most`` rows of ``counts`` (n) reach."""
    sizes = counts.filter(F.col("n") >= least).groupBy("n").agg(F.count(F.lit(1)).alias("rows"))
    above = F.sum("rows").over(Window.orderBy(F.col("n").desc()))  # a row per count
    found = sizes.select("n", above.alias("above")).filter(F.col("above") <= most).agg(F.min("n")).first()[0]
    return found if found is not None else (1 << 62)


def vocabulary_of(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted hashes of the most frequent tokens of ``texts`` (text), none of which comes only once; how often each comes; and the number of all tokens."""
    spark, path = texts.sparkSession, scratch_path(texts.sparkSession, "tokens")
    # A compressed file, which takes a fraction of a checkpoint's bytes.
    _summed(texts, lambda raw, offsets: Tokens(raw, offsets).hashes.view(np.int64), "token").write.option("compression", "zstd").parquet(path)
    counts = spark.read.schema("token long, n long").parquet(path)
    least = _at_least(counts, VOCABULARY, 2)
    rows = counts.filter(F.col("n") >= least).select("token", "n").toArrow()  # VOCABULARY rows at most
    hashes, n = rows.column("token").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order, total = np.argsort(hashes), counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    delete_path(spark, path)
    return hashes[order], n[order], total


def squeeze(a: np.ndarray) -> bytes:
    """Numbers by their bytes' places, compressed."""
    return pa.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T), codec="zstd", asbytes=True)


def unsqueeze(data: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(data, n * size, codec="zstd"), np.uint8).reshape(size, n)
    return np.ascontiguousarray(raw.T).reshape(-1).view(kind)


def _packed(values: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Numbers of at most 25 bits: their lengths in bits, and the bits below the highest one, one after another."""
    lengths = np.frexp(values.astype(float))[1]
    bits = np.maximum(lengths.astype(np.int64) - 1, 0)
    end = np.cumsum(bits)
    begin = end - bits
    size = (int(end[-1]) + 7) // 8
    window = (values & ((1 << bits) - 1)) << (32 - (begin & 7) - bits)
    out = np.zeros(size + 4)
    for i in range(4):
        out += np.bincount((begin >> 3) + i, weights=(window >> (24 - 8 * i)) & 255, minlength=size + 4)[: size + 4]
    return lengths.astype(np.uint8), out[:size].astype(np.uint8).tobytes()


def _unpacked(lengths: np.ndarray, data: bytes) -> np.ndarray:
    bits = np.maximum(lengths.astype(np.int64) - 1, 0)
    begin = np.cumsum(bits) - bits
    raw = np.frombuffer(data + bytes(5), np.uint8).astype(np.int64)
    at = begin >> 3
    window = (raw[at] << 24) | (raw[at + 1] << 16) | (raw[at + 2] << 8) | raw[at + 3]
    low = (window >> (32 - (begin & 7) - bits)) & ((1 << bits) - 1)
    return np.where(lengths > 0, low | (1 << bits), 0)


def _steps(values: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Differences of neighbours; values as they are where ``fresh``."""
    return np.where(fresh, values, np.diff(values, prepend=0))


def _sums(steps: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    total = np.cumsum(steps)
    first = np.flatnonzero(fresh)
    return total - (total - steps)[first][np.cumsum(fresh) - 1]


def pack_grams(keys: np.ndarray) -> bytes:
    """Sorted trigrams, word by word: a new middle number, a new first one or a new last one only, each by its distance where what comes before it is the same.

    Frequent words have small numbers; a difference of whole trigrams would hide that.
    """
    if not len(keys):
        return b""
    middle, first, last = keys >> (2 * BITS), (keys >> BITS) & (IDS - 1), keys & (IDS - 1)
    new_middle = np.r_[True, middle[1:] != middle[:-1]]
    new = new_middle | np.r_[True, first[1:] != first[:-1]]
    streams = [np.diff(middle[new_middle], prepend=0), _steps(first[new], new_middle[new]), _steps(last, new)]
    lengths, bits = _packed(np.concatenate(streams))
    parts = [new.astype(np.uint8) + new_middle, *np.split(lengths, np.cumsum([len(x) for x in streams[:2]]))]
    blocks = [pa.compress(np.ascontiguousarray(x, np.uint8), codec="zstd", asbytes=True) for x in parts]
    return b"".join([np.array([len(b) for b in blocks], np.uint32).tobytes(), *blocks, bits])


def unpack_grams(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, np.int64)
    ends = (16 + np.cumsum(np.frombuffer(data[:16], np.uint32).astype(np.int64))).tolist()
    kind = np.frombuffer(pa.decompress(data[16 : ends[0]], n, codec="zstd"), np.uint8)
    new, new_middle = kind > 0, kind > 1
    sizes = [int(new_middle.sum()), int(new.sum()), n]
    lengths = [np.frombuffer(pa.decompress(data[a:b], size, codec="zstd"), np.uint8) for a, b, size in zip(ends, ends[1:], sizes)]
    middles, firsts, lasts = np.split(_unpacked(np.concatenate(lengths), data[ends[3] :]), np.cumsum(sizes[:2]))
    middle = np.cumsum(middles)[np.cumsum(new_middle) - 1]
    first = _sums(firsts, new_middle[new])[np.cumsum(new) - 1]
    return (middle << (2 * BITS)) | (first << BITS) | _sums(lasts, new)


@dataclass
class Figures:
    """What all shards share: discounts of trigrams and bigrams, and per number its mass and back-off weight as a context, and its probability."""

    trigram_costs: np.ndarray
    bigram_costs: np.ndarray
    mass: np.ndarray
    backoff: np.ndarray
    p: np.ndarray


@dataclass
class Model:
    """What every task has: sorted vocabulary and ranks, values of numbers, the head (sorted keys, values); ``parts``: of how many shards a middle number has trigrams."""

    vocabulary: np.ndarray
    ranks: np.ndarray
    numbers: np.ndarray
    head: np.ndarray
    head_values: np.ndarray
    shards: int
    parts: np.ndarray
    figures: Figures

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values by the head, and which of the keys it has."""
        values, found = np.zeros(len(keys)), np.zeros(len(keys), bool)
        if len(self.head):
            at = np.searchsorted(self.head, keys)
            at[at == len(self.head)] = 0
            found = self.head[at] == keys
            values[found] = self.head_values[at[found]]
        return values, found


def shard_of(gram: np.ndarray, parts: np.ndarray, shards: int) -> np.ndarray:
    """A trigram's shard: by its middle number, for frequent ones by the last one too."""
    middle = gram >> (2 * BITS)
    part = _spread(gram & (IDS - 1)) % parts[middle]
    return ((_spread(middle) + part) % shards).astype(np.int32)


def _spread(numbers: np.ndarray) -> np.ndarray:
    return (mix(numbers.view(np.uint64)) >> np.uint64(40)).view(np.int64)


def _costs(n: np.ndarray, costs: np.ndarray) -> np.ndarray:
    return costs[np.minimum(n, 3) - 1]


def discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of 1, 2 and more, from how many have the counts 1, 2, 3 and 4."""
    n1, n2, n3, n4 = map(float, n)
    if not (n1 and n2):
        return np.array([0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return np.array([min(max(x, 0.05), k - 0.05) for x, k in zip(d, (1.0, 2.0, 3.0))])


def _runs(a: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, a[1:] != a[:-1]])


class Counted:
    """A shard's sorted trigrams with their counts, and their contexts and suffixes; all of a suffix's trigrams are in one shard."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        context = context_of(keys)
        self.begin = _runs(context)
        self.contexts, self.kinds = context[self.begin], np.diff(np.r_[self.begin, len(keys)])
        self.suffixes, self.suffix, self.left = np.unique(suffix_of(keys), return_inverse=True, return_counts=True)

    def sums(self, costs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per context the sum of its counts, and what the discounts take from it."""
        return np.add.reduceat(self.counts, self.begin).astype(float), np.add.reduceat(_costs(self.counts, costs), self.begin)


class Part:
    """A shard's part of the model.  ``others``: sorted contexts of frequent middle numbers, whose trigrams are in several shards, and their sums."""

    def __init__(self, counted: Counted, figures: Figures, others: tuple[np.ndarray, np.ndarray, np.ndarray] | None):
        mass, taken = counted.sums(figures.trigram_costs)
        self.contexts, at = counted.contexts, np.arange(len(counted.contexts))
        if others is not None:
            every = np.r_[others[0], self.contexts]
            self.contexts, first = np.unique(every, return_index=True)
            mass, taken = np.r_[others[1], mass][first], np.r_[others[2], taken][first]
            at = np.searchsorted(self.contexts, counted.contexts)
        backoff = taken / mass
        self.context_values = np.log(backoff)
        self.suffixes, self.keys = counted.suffixes, counted.keys
        middle, last = self.suffixes >> BITS, self.suffixes & (IDS - 1)
        below = figures.backoff[middle] * figures.p[last]
        p = (counted.left - _costs(counted.left, figures.bigram_costs)) / figures.mass[middle] + below
        self.suffix_values = np.log(p / below)
        at = np.repeat(at, counted.kinds)
        p = (counted.counts - _costs(counted.counts, figures.trigram_costs)) / mass[at] + backoff[at] * p[counted.suffix]
        self.values = np.log(p / below[counted.suffix])

    def of(self, grams: np.ndarray) -> np.ndarray:
        """The log of trigrams' probabilities over what backing off twice without a context's weight gives."""

        def known(table: np.ndarray, values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.searchsorted(table, keys)
            at[at == len(table)] = 0
            found = table[at] == keys
            return np.where(found, values[at], 0.0), found

        out, found = known(self.keys, self.values, grams)
        rest = grams[~found]
        out[~found] = known(self.contexts, self.context_values, context_of(rest))[0] + known(self.suffixes, self.suffix_values, suffix_of(rest))[0]
        return out


#: What comes to a shard: contexts that other shards have too (kind -1), its counted trigrams (0), the trigrams of a
#: piece (1) and, on their way, documents (2); what it returns: sums of a piece's documents (3).
_MIXED = "kind int, shard int, salt int, piece long, at int, doc_id long, lang string, key1 long, key2 long, n long, part double, size int, occurrences int, keys binary, counts binary, owners binary"
_NAMES = [c.split()[0] for c in _MIXED.split(", ")]


def _batch(rows: int, **columns: pa.Array) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(rows, types[t]) for c, t in (x.split() for x in _MIXED.split(", "))], _NAMES)


def counted_rows(texts: DataFrame, vocabulary: np.ndarray, ranks: np.ndarray, parts: np.ndarray, shards: int) -> DataFrame:
    """One row of kind 0 per shard that has any: the trigrams of ``texts`` (text) and their counts."""
    shared = texts.sparkSession.sparkContext.broadcast((vocabulary, ranks, parts))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, ranks, parts = shared.value
        seen, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        held: list[np.ndarray] = []
        size = 0

        def add() -> None:
            nonlocal seen, counts, held, size
            new, n = np.unique(np.concatenate(held), return_counts=True)
            seen, counts = _merged([seen, new], [counts, n])
            held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal seen, counts
            shard = shard_of(seen, parts, shards)
            for s in np.unique(shard).tolist():
                yield _counts_row(s, seen[shard == s], counts[shard == s])
            seen, counts = np.empty(0, np.int64), np.empty(0, np.int64)

        for batch in batches:
            raw, offsets = text_buffers(batch.column(0))
            for a, b in slices(offsets):
                tokens = Tokens(raw, offsets[a : b + 1])
                sequence, _, place = sequences(tokens.numbers(vocabulary, ranks), tokens.first)
                held.append(middle_first(sequence, np.flatnonzero(place >= ORDER - 1)))
                size += len(held[-1])
                if size >= COUNT_AT_ONCE:
                    add()
                    if len(seen) >= SUMS_AT_ONCE:
                        yield from out()
        if held:
            add()
        yield from out()
        give_back()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys, counts = None, [], []
        for batch in batches:
            for i in range(batch.num_rows):
                s = batch.column(1)[i].as_py()
                if s != shard and keys:
                    yield _counts_row(shard, *_merged(keys, counts))
                    keys, counts = [], []
                shard = s
                k, n = _counts_of(batch, i)
                keys.append(k)
                counts.append(n)
        if keys:
            yield _counts_row(shard, *_merged(keys, counts))
        give_back()

    rows = small_batches(texts).select(F.col("text").cast("string")).mapInArrow(cut_up, _MIXED)
    return rows.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(gather, _MIXED)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the sums of their counts."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    if not len(key):
        return key, n
    begin = _runs(key)
    return key[begin], np.add.reduceat(n, begin)


def _counts_row(shard: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return _batch(1, kind=pa.array([0], pa.int32()), shard=pa.array([shard], pa.int32()), size=pa.array([len(keys)], pa.int32()), keys=pa.array([squeeze(np.diff(keys, prepend=0))], pa.binary()), counts=pa.array([squeeze(counts)], pa.binary()))


def _counts_of(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    size, keys, counts = (batch.column(_NAMES.index(c))[i].as_py() for c in ("size", "keys", "counts"))
    return np.cumsum(unsqueeze(keys, size, np.int64)), unsqueeze(counts, size, np.int64)


#: What ``_totals`` counts: trigrams and bigrams by their counts up to 5; trigrams by any count; per last number its bigrams;
#: per middle number its bigrams of one, two and more left neighbours, and all these neighbours.
_TRIGRAMS, _BIGRAMS, _ENTRIES, _LAST, _ONE, _TWO, _MORE, _MASS = range(8)


def _totals(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per kind of total its ids and numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c = Counted(*_counts_of(batch, i))
                middle, last = c.suffixes >> BITS, c.suffixes & (IDS - 1)
                found = [(_TRIGRAMS, np.minimum(c.counts, 5)), (_BIGRAMS, np.minimum(c.left, 5)), (_ENTRIES, c.counts), (_LAST, last)]
                found += [(role, middle[at]) for role, at in ((_ONE, c.left == 1), (_TWO, c.left == 2), (_MORE, c.left > 2))]
                out = [(role, *np.unique(ids, return_counts=True)) for role, ids in found]
                begin = _runs(middle)
                out.append((_MASS, middle[begin], np.add.reduceat(c.left, begin)))
                for role, ids, n in out:
                    yield pa.RecordBatch.from_pydict({"role": pa.array(np.full(len(ids), role, np.int32)), "id": pa.array(ids, pa.int64()), "n": pa.array(n, pa.int64())})

    table = rows.mapInArrow(run, "role int, id long, n long").groupBy("role", "id").agg(F.sum("n").alias("n")).toArrow()  # IDS rows a role at most, or one per count
    role, ids, n = (table.column(c).to_numpy() for c in ("role", "id", "n"))
    return {r: (ids[role == r], n[role == r]) for r in range(8)}


def _others(rows: DataFrame, parts: np.ndarray, shards: int, costs: np.ndarray) -> DataFrame:
    """Rows of kind -1: to each shard the contexts of the numbers whose trigrams it shares with others, summed up over all of these."""
    shared = rows.sparkSession.sparkContext.broadcast(parts)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c = Counted(*_counts_of(batch, i))
                split = shared.value[c.contexts >> BITS] > 1
                mass, taken = c.sums(costs)
                yield pa.RecordBatch.from_pydict({"gram": pa.array(c.contexts[split]), "mass": pa.array(mass[split]), "taken": pa.array(taken[split])})

    def address(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            middle = batch.column(0).to_numpy() >> BITS
            many = shared.value[middle]
            row = np.repeat(np.arange(len(many)), many)
            part = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            shard = (_spread(middle)[row] + part) % shards
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *(c.take(pa.array(row)) for c in batch.columns)], ["shard", "gram", "mass", "taken"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, *columns = (c.to_numpy() for c in batch.columns)
            for s in np.unique(shard).tolist():
                gram, mass, taken = (c[shard == s] for c in columns)
                yield _batch(1, kind=pa.array([-1], pa.int32()), shard=pa.array([s], pa.int32()), size=pa.array([len(gram)], pa.int32()), keys=pa.array([squeeze(np.diff(gram, prepend=0))], pa.binary()), counts=pa.array([squeeze(mass)], pa.binary()), owners=pa.array([squeeze(taken)], pa.binary()))

    sums = rows.mapInArrow(partial, "gram long, mass double, taken double").groupBy("gram").agg(F.sum("mass").alias("mass"), F.sum("taken").alias("taken"))
    return sums.mapInArrow(address, "shard int, gram long, mass double, taken double").repartition(shards, "shard").sortWithinPartitions("shard", "gram").mapInArrow(gather, _MIXED)


class Assembly:
    """Puts a shard's part together from its rows, which come in the order of their kinds."""

    def __init__(self, figures: Figures):
        self.figures, self.others = figures, []
        self.shard = self.part = self.counted = None

    def take(self, batch: pa.RecordBatch, i: int, kind: int, shard: int) -> None:
        if kind < 0:
            if self.others and self.others[0][0] != shard:
                self.others = []
            size, keys, mass, taken = (batch.column(_NAMES.index(c))[i].as_py() for c in ("size", "keys", "counts", "owners"))
            self.others.append((shard, np.cumsum(unsqueeze(keys, size, np.int64)), unsqueeze(mass, size, np.float64), unsqueeze(taken, size, np.float64)))
            return
        own = [x[1:] for x in self.others if x[0] == shard]
        self.counted = Counted(*_counts_of(batch, i))
        self.shard, self.part, self.others = shard, Part(self.counted, self.figures, tuple(map(np.concatenate, zip(*own))) if own else None), []


def _each_part(rows: DataFrame, figures: Figures, of, schema: str) -> DataFrame:
    """What ``of(assembly)`` yields for each shard's part."""
    shared = rows.sparkSession.sparkContext.broadcast(figures)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assembly = Assembly(shared.value)
        for batch in batches:
            kind, shard = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i in range(batch.num_rows):
                assembly.take(batch, i, kind[i], shard[i])
                if kind[i] == 0:
                    yield from of(assembly)
        give_back()

    return rows.mapInArrow(run, schema)


def train(texts: DataFrame) -> tuple[Model, DataFrame] | None:
    """The model of ``texts`` (text) and its shards' rows; None without tokens."""
    vocabulary, often, total = vocabulary_of(texts)
    if not total:
        return None
    # Frequent words have small numbers, which take fewer bytes.
    ranks = np.empty(len(often), np.int32)
    ranks[np.argsort(-often, kind="stable")] = np.arange(len(often), dtype=np.int32)
    shards = max(1, -(-total // SHARD_GRAMS))
    parts = np.ones(IDS, np.int64)
    parts[SHAPE:WORD] = -(-(total - int(often.sum())) // SHARD_GRAMS)
    parts[WORD + ranks] = -(-often // SHARD_GRAMS)
    parts = np.clip(parts, 1, shards)
    rows = cut(counted_rows(texts, vocabulary, ranks, parts, shards))
    release(texts.sparkSession)
    totals = _totals(rows)

    def how_many(role: int) -> list[int]:
        found = dict(zip(*(x.tolist() for x in totals[role])))
        return [found.get(i, 0) for i in (1, 2, 3, 4)]

    def by_number(role: int) -> np.ndarray:
        out = np.zeros(IDS, np.int64)
        out[totals[role][0]] = totals[role][1]
        return out

    n = by_number(_LAST)
    costs = discounts([int((n == i).sum()) for i in (1, 2, 3, 4)])
    seen, taken = n > 0, np.where(n > 0, _costs(np.maximum(n, 1), costs), 0.0)
    p = np.full(IDS, taken.sum() / n.sum() / (WORD + len(vocabulary)))
    p[seen] += ((n - taken) / n.sum())[seen]
    bigram_costs = discounts(how_many(_BIGRAMS))
    mass = by_number(_MASS)
    backoff = np.ones(IDS)
    backoff[mass > 0] = (np.stack([by_number(r) for r in (_ONE, _TWO, _MORE)], 1) @ bigram_costs)[mass > 0] / mass[mass > 0]
    figures = Figures(discounts(how_many(_TRIGRAMS)), bigram_costs, mass, backoff, p)
    numbers = np.log(p)
    numbers[START] = 0.0
    numbers += np.log(backoff)
    # Only the sums are kept beside the counts; both meet in the shuffles that need them.
    whole = rows
    if (parts > 1).any():
        rows = rows.union(cut(_others(rows, parts, shards, figures.trigram_costs)))
        whole = rows.repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    entries, many = totals[_ENTRIES]
    down = np.argsort(-entries)
    fits = entries[down][np.cumsum(many[down]) <= HEAD]
    least = int(fits[-1]) if len(fits) else 1 << 62

    def frequent(assembly: Assembly) -> Iterator[pa.RecordBatch]:
        often = assembly.counted.counts >= least
        yield pa.RecordBatch.from_pydict({"key": pa.array(assembly.part.keys[often]), "value": pa.array(assembly.part.values[often])})

    head = _each_part(whole, figures, frequent, "key long, value double").toArrow()  # HEAD rows at most
    keys, values = head.column("key").to_numpy(), head.column("value").to_numpy()
    order = np.argsort(keys)
    return Model(vocabulary, ranks, numbers, keys[order], values[order], shards, parts, figures), rows


def log_perplexities(docs: DataFrame, model: Model, shard_rows: DataFrame) -> DataFrame:
    """doc_id, lang, key1, key2, n_tokens and log_perplexity (null without tokens) of ``docs`` (doc_id, lang, text, key1, key2)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by VOCABULARY, IDS and HEAD
    shards = model.shards
    # A task takes what four tasks have cut; the model's shards are repeated only so often.
    salts = max(1, -(-shuffle_width(spark) // (4 * shards)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, number, held, size = shared.value, TaskContext.get().partitionId() << 24, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, held, size
            rows = pa.Table.from_batches([x[0] for x in held]).combine_chunks().to_batches()[0]
            n = rows.num_rows
            tokens = np.concatenate([x[3] for x in held])
            base, keys, owners, before = np.zeros(n), [], [], 0
            for batch, numbers, text, _, place in held:
                text, sequence = text + np.int32(before), numbers.astype(np.int64)
                before += batch.num_rows
                at = np.flatnonzero(place >= ORDER - 2)
                base += np.bincount(text[at], weights=model.numbers[sequence[at]], minlength=n)
                at = np.flatnonzero(place >= ORDER - 1)
                gram = middle_first(sequence, at)
                value, found = model.lookup(gram)
                base += np.bincount(text[at], weights=value, minlength=n)
                keys.append(gram[~found])
                owners.append(text[at][~found])
            yield _batch(n, kind=pa.array(np.full(n, 2, np.int32)), shard=pa.array(np.arange(n, dtype=np.int32) % shards), salt=pa.array(np.full(n, (number >> 2) % salts, np.int32)), piece=pa.array(np.full(n, number)), at=pa.array(np.arange(n, dtype=np.int32)), doc_id=rows.column(0), lang=rows.column(1), key1=rows.column(3), key2=rows.column(4), n=pa.array(tokens), part=pa.array(base))
            held, size = [], 0
            key, owner = np.concatenate(keys), np.concatenate(owners)
            keys = owners = None
            order = np.lexsort((owner, key))
            key, owner = key[order], owner[order]
            begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
            distinct, counts = key[begin], np.diff(np.r_[begin, len(key)])
            shard = shard_of(distinct, model.parts, shards)
            each = np.repeat(shard, counts)
            out = []
            for s in np.unique(shard).tolist():
                mine = shard == s
                own = owner[each == s]
                out.append((s, int(mine.sum()), len(own), pack_grams(distinct[mine]), squeeze(counts[mine].astype(np.uint32)), squeeze(own.astype(np.uint32))))
            if out:
                s, sizes, many, a, b, c = zip(*out)
                m = len(out)
                yield _batch(m, kind=pa.array(np.full(m, 1, np.int32)), shard=pa.array(s, pa.int32()), salt=pa.array(np.full(m, (number >> 2) % salts, np.int32)), piece=pa.array(np.full(m, number)), size=pa.array(sizes, pa.int32()), occurrences=pa.array(many, pa.int32()), keys=pa.array(a, pa.binary()), counts=pa.array(b, pa.binary()), owners=pa.array(c, pa.binary()))
            number += 1
            key = owner = distinct = counts = order = each = None
            give_back()

        for batch in batches:
            raw, offsets = text_buffers(batch.column(2))
            for a, b in slices(offsets):
                tokens = Tokens(raw, offsets[a : b + 1])
                sequence, text, place = sequences(tokens.numbers(model.vocabulary, model.ranks), tokens.first)
                part = batch.slice(a, b - a)
                held.append((part.set_column(2, "text", pa.nulls(b - a)), sequence.astype(np.int32), text, np.diff(tokens.first), place))
                size += int(offsets[b] - offsets[a])
                if size >= PIECE_BYTES:
                    yield from flush()
        if held:
            yield from flush()
        give_back()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by shard, the shard's own rows first."""
        assembly = Assembly(shared.value.figures)
        for batch in batches:
            kind, shard = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i in np.flatnonzero(kind < 2).tolist():
                if kind[i] < 1:
                    assembly.take(batch, i, kind[i], shard[i])
                    continue
                if assembly.shard != shard[i]:
                    continue  # a shard without trigrams knows none
                row = {c: batch.column(c)[i].as_py() for c in ("size", "occurrences", "piece", "keys", "counts", "owners")}
                value = assembly.part.of(unpack_grams(row["keys"], row["size"]))
                counts, owners = unsqueeze(row["counts"], row["size"], np.uint32), unsqueeze(row["owners"], row["occurrences"], np.uint32)
                part = np.bincount(owners, weights=np.repeat(value, counts))
                at = np.flatnonzero(part)
                yield _batch(1, kind=pa.array([3], pa.int32()), shard=pa.array([shard[i]], pa.int32()), piece=pa.array([row["piece"]]), size=pa.array([len(at)], pa.int32()), keys=pa.array([squeeze(np.diff(at, prepend=0).astype(np.uint32))], pa.binary()), counts=pa.array([squeeze(part[at].astype(np.float32))], pa.binary()))
            if (kind == 2).any():
                yield batch.filter(pa.array(kind == 2))
        give_back()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by piece, its documents first, sums always in the same order."""
        piece, held, places, parts = None, [], [], []

        def out() -> Iterator[pa.RecordBatch]:
            at, part = np.concatenate([*places, np.empty(0, np.int64)]), np.concatenate([*parts, np.empty(0)])
            total = np.bincount(at.astype(np.int64), weights=part, minlength=1)
            for rows in held:
                place = rows.column("at").to_numpy()
                more = np.where(place < len(total), total[np.minimum(place, len(total) - 1)], 0.0)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("doc_id", "lang", "key1", "key2", "n")), pa.array(rows.column("part").to_numpy() + more)], ["doc_id", "lang", "key1", "key2", "n", "total"])

        for batch in batches:
            kind, pieces = batch.column(0).to_numpy(), batch.column("piece").to_numpy()
            begin = _runs(pieces) if len(pieces) else []
            for a, b in zip(begin, [*begin[1:], len(pieces)]):
                if pieces[a] != piece:
                    yield from out()
                    piece, held, places, parts = pieces[a], [], [], []
                documents = int((kind[a:b] == 2).sum())
                if documents:
                    held.append(batch.slice(a, documents))
                for i in range(a + documents, b):
                    size, keys, counts = (batch.column(c)[i].as_py() for c in ("size", "keys", "counts"))
                    places.append(np.cumsum(unsqueeze(keys, size, np.uint32)).astype(np.int64))
                    parts.append(unsqueeze(counts, size, np.float32).astype(float))
        yield from out()

    cut_up = small_batches(docs).select("doc_id", "lang", "text", "key1", "key2").mapInArrow(look, _MIXED)
    model_rows = shard_rows.drop("salt").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select(*_NAMES)
    mixed = model_rows.union(cut_up).repartition(shards * salts, "shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    answers = mixed.mapInArrow(answer, _MIXED).repartition(max(shuffle_width(spark), shards), "piece").sortWithinPartitions("piece", "kind", "shard")
    sums = answers.mapInArrow(add_up, "doc_id long, lang string, key1 long, key2 long, n long, total double")
    x = F.when(F.col("n") > 0, F.round(-F.col("total") / (F.col("n") + 1), 6))
    return sums.select("doc_id", "lang", "key1", "key2", F.col("n").alias("n_tokens"), x.alias("log_perplexity"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of documents that some label calls good and none calls bad or toxic."""
    bad = (F.coalesce("quality", F.lit(0)) != 1) | (F.coalesce("toxic", F.lit(0)) == 1)
    return labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(bad.cast("int")).alias("bad")).filter("bad = 0").select(F.col("doc_id").cast("long").alias("doc_id"))


def trusted_folds(labels: DataFrame) -> DataFrame:
    """doc_id, held: all trusted documents; those held, a fold by a hash of the id, are for the thresholds."""
    return cut(trusted_ids(labels).select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(HELD_OUT)) == 0).alias("held")))


#: The name by which this was known when it took a sample.
sampled_ids = trusted_folds


def rows_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one of ``ids`` (doc_id, each once), by a pass for each batch of ids; ``docs`` aren't shuffled."""
    n = max(1, -(-ids.count() // IDS_AT_ONCE))
    part = F.pmod(F.xxhash64("doc_id", F.lit("batch")), F.lit(n))
    legs = [docs.join(F.broadcast(ids.filter(part == i) if n > 1 else ids), "doc_id", "left_semi") for i in range(n)]
    return reduce(DataFrame.union, legs)


def deviation(log_perplexity: Column, n_tokens: Column, centre: Column) -> Column:
    """Distance from the centre; that of short texts is scaled down to what long ones show."""
    return (log_perplexity - centre) * F.sqrt(F.least(F.lit(1.0), n_tokens / F.lit(float(LONG))))


def _quantiles(rows: DataFrame, value: Column, q: float) -> DataFrame:
    """key, n, mid: the smallest grid value that at least q of a key's rows don't exceed; key ``*`` has all rows."""
    both = rows.select(F.explode(F.array("key", F.lit("*"))).alias("key"), F.ceil(value / GRID).alias("bin"))
    bins = both.groupBy("key", "bin").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("key").orderBy("bin")) / F.sum("n").over(Window.partitionBy("key"))
    return bins.select("key", "bin", "n", upto.alias("upto")).groupBy("key").agg(F.sum("n").alias("n"), (F.min(F.when(F.col("upto") >= q, F.col("bin"))) * GRID).alias("mid"))


def _drawn(quantiles: DataFrame) -> tuple[float, DataFrame]:
    """The quantile of all languages, and key, value: those of each, drawn to it."""
    every = quantiles.filter("key = '*'").first()["mid"]
    return every, quantiles.filter("key <> '*'").select("key", ((F.col("n") * F.col("mid") + PRIOR * F.lit(every)) / (F.col("n") + PRIOR)).alias("value"))


def language_key(lang: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), lang), F.lit("-"))


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, key1, key2, n_tokens, log_perplexity, threshold, deviation and kept of ``docs`` (doc_id, lang, text, key1, key2)."""
    chosen = trusted_folds(labels)
    none = F.lit(None).cast("double")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    untold = docs.select("doc_id", "lang", "key1", "key2", size.alias("n_tokens"), none.alias("log_perplexity"), none.alias("threshold"), none.alias("deviation"), (size > 0).alias("kept"))
    trusted = rows_of(docs.select("doc_id", "text"), chosen.filter("not held").select("doc_id"))
    fitted = train(trusted.select("text"))
    if fitted is None:
        return untold
    release(docs.sparkSession)
    scored = cut(log_perplexities(docs, *fitted))
    del fitted
    release(docs.sparkSession)
    held = join_small(scored.filter("log_perplexity is not null"), chosen.filter("held").select("doc_id"), "doc_id", "left_semi")
    held = cut(held.select(language_key(F.col("lang")).alias("key"), "n_tokens", "log_perplexity"))
    if held.isEmpty():
        return untold
    any_centre, centres = _drawn(cut(_quantiles(held, F.col("log_perplexity"), 0.5)))
    centre = F.coalesce("value", F.lit(any_centre))
    off = cut(join_small(held, cut(centres), "key", "left").select("key", deviation(F.col("log_perplexity"), F.col("n_tokens"), centre).alias("off")))
    any_limit, limits = _drawn(cut(_quantiles(off, F.col("off"), QUANTILE)))
    limits = cut(centres.withColumnRenamed("value", "centre").join(limits.withColumnRenamed("value", "limit"), "key"))
    rows = join_small(scored.withColumn("key", language_key(F.col("lang"))), limits, "key", "left")
    centre, limit = F.coalesce("centre", F.lit(any_centre)), F.coalesce("limit", F.lit(any_limit))
    off = deviation(F.col("log_perplexity"), F.col("n_tokens"), centre)
    threshold = F.when(F.col("n_tokens") > 0, centre + limit / F.sqrt(F.least(F.lit(1.0), F.col("n_tokens") / F.lit(float(LONG)))))
    return rows.select("doc_id", "lang", "key1", "key2", "n_tokens", "log_perplexity", threshold.alias("threshold"), off.alias("deviation"), F.coalesce(off <= limit, F.lit(False)).alias("kept"))


def _plain(docs: DataFrame) -> DataFrame:
    """doc_id, lang and text, and two hashes by which rows with equal verdicts are known again."""
    text, lang = F.col("text").cast("string"), F.col("lang").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), text.alias("text"), F.xxhash64(lang, text).alias("key1"), F.xxhash64(F.lit(1), text, lang).alias("key2"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_tokens, log_perplexity, threshold, deviation and kept per row of ``docs``.

    ``docs`` has doc_id, text and lang; ``labels`` has doc_id, quality and toxic,
    and its good documents are the trusted text.  A document is kept if its log
    perplexity is not above its threshold.  Null and empty texts, and those of
    white space only, have no perplexity and are not kept.  A null language is one
    of its own.  Without trusted text, or without any that is held out, every text
    that isn't empty is kept, and n_tokens is its length in bytes.  Rows that
    repeat are returned as often as they come; other columns are ignored; an empty
    table gives an empty result.  Whole texts are read whatever their length.
    """
    return verdicts(_plain(docs), labels).drop("key1", "key2")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns, whatever these are called.

    Rows go if they have language and text of a rejected one.
    """
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    text, lang = F.col("row.text").cast("string"), F.col("row.lang").cast("string")
    own = own.select("row", F.struct(F.xxhash64(lang, text).alias("key1"), F.xxhash64(F.lit(1), text, lang).alias("key2")).alias("key"))
    bad = cut(verdicts(_plain(docs), labels).filter("not kept").select(F.struct("key1", "key2").alias("key")).distinct())
    return join_small(own, bad, "key", "left_anti").select("row.*")
