"""Token ids in Simple-8b segments, written and read back in document order.

Simple-8b: a 64-bit word holds a 4-bit selector and 60 bits of payload, which
the selector divides into equal fields.  Blocks of 512 ids start at a word of
their own and have their word offset noted, so all blocks of a segment are
packed and unpacked side by side by array operations.  An id that doesn't fit in
60 bits follows, whole, an escape word of all ones.

A segment holds whole documents, of ``SEGMENT_IDS`` ids or a little more (a
longer document has a segment of its own)::

    4s magic  u4 documents  u8 ids  u4 blocks  u4 words  u4 crc32 of what follows
    i8 doc_id per document      u1 null flag per document
    u8 ids per document         u4 word offset per block
    u8 words

Segments are rows of a Parquet table, with their place in the order: it is what
Spark can write to any store as a whole or not at all.  Words are encoded once
each where the tokenizer's file says that it never joins them: text is cut at
white space and between letters, digits and signs, and ids are looked up per run;
runs not yet seen go to the tokenizers library in a batch.  Any other tokenizer is
given whole texts.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.llm.bytewise import slices, span_hashes, text_buffers
from larkspur.llm.frames import shuffle_width, small_batches

#: Values per word and bits per value for the selectors 0 to 15.
FIELDS = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
BLOCK_IDS = 512
SEGMENT_IDS = 1 << 18
ESCAPE = np.uint64(0xFFFFFFFFFFFFFFFF)
_LARGEST = np.uint64((1 << 60) - 2)
_PAD = FIELDS[0][0]
_HEAD = struct.Struct("<4sIQIII")
_MAGIC = b"S8B1"
#: Words whose ids a worker keeps; beyond them the half used last stays.
KNOWN_WORDS = 700_000
#: Text that is encoded at once; the more, the fewer distinct words there are in it.
ENCODE_BYTES = 1 << 21


_SMALL_BITS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def _bit_lengths(ids: np.ndarray) -> np.ndarray:
    if ids.max(initial=0) < len(_SMALL_BITS):
        return _SMALL_BITS[ids.astype(np.intp)]
    bits = np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    if len(ids) and ids.max() >= 1 << 53:  # float64 may round up to the next power of two
        big = ids >= 1 << 53
        bits[big] = [int(x).bit_length() for x in ids[big]]
    return bits


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the word offset of each block of 512 ids (with the end)."""
    n = len(ids)
    blocks = -(-n // BLOCK_IDS)
    if not n:
        return np.empty(0, np.uint64), np.zeros(1, np.uint32)
    values = np.zeros((blocks, BLOCK_IDS + _PAD), np.uint64)
    flat = np.zeros(blocks * BLOCK_IDS, np.uint64)
    flat[:n] = ids
    values[:, :BLOCK_IDS] = flat.reshape(blocks, BLOCK_IDS)
    escaped = values > _LARGEST
    width = _bit_lengths(values.reshape(-1)).reshape(values.shape)
    width[escaped] = 64
    # Largest width among the next c values, for each field count c, from shorter windows.
    best = np.full(width.shape, 15, np.uint8)
    window, covered = width, 1
    for selector in range(14, -1, -1):
        count, bits = FIELDS[selector]
        while covered < count:
            step = min(covered, count - covered)
            wider = window.copy()
            np.maximum(window[:, :-step], window[:, step:], out=wider[:, :-step])
            window, covered = wider, covered + step
        fits = window <= bits
        if not fits.any():  # more and narrower fields fit nowhere either
            break
        np.copyto(best, np.uint8(selector), where=fits)
    counts = np.array([c for c, _ in FIELDS])
    lengths = np.full(blocks, BLOCK_IDS)
    lengths[-1] = n - (blocks - 1) * BLOCK_IDS
    best, values, escaped, wide = best.reshape(-1), values.reshape(-1), escaped.reshape(-1), values.shape[1]
    at = np.arange(blocks) * wide
    ends = at + lengths
    seen = []
    while len(at):  # one word of every block at a time
        seen.append(at)
        at = at + counts.take(best.take(at))
        live = at < ends
        if not live.all():
            at, ends = at[live], ends[live]
    steps = np.repeat(np.arange(len(seen)), [len(x) for x in seen])
    place = np.concatenate(seen)
    row = place // wide
    words_of = np.bincount(row, minlength=blocks)
    target = (np.cumsum(words_of) - words_of)[row] + steps
    by_place = np.empty(len(row), np.int64)
    by_place[target] = np.arange(len(row))
    row, place = row[by_place], place[by_place]
    selector = best.take(place)
    out = selector.astype(np.uint64) << np.uint64(60)
    for s in np.unique(selector).tolist():
        count, bits = FIELDS[s]
        if bits:
            mine = np.flatnonzero(selector == s)
            fields = values.take(place[mine, None] + np.arange(count))
            shifted = fields << (np.arange(count) * bits).astype(np.uint64)
            out[mine] |= np.bitwise_or.reduce(shifted, axis=1)
    big = escaped.take(place) & (selector == 15)
    if big.any():
        out[big] = ESCAPE
        raw = np.flatnonzero(big)
        out = np.insert(out, raw + 1, values.take(place[raw]))
        per_block = np.bincount(row, minlength=blocks) + np.bincount(row[raw], minlength=blocks)
    else:
        per_block = np.bincount(row, minlength=blocks)
    return out, np.r_[0, np.cumsum(per_block)].astype(np.uint32)


def unpack(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids (uint64) that ``pack`` put into ``words``."""
    blocks = len(offsets) - 1
    if not n:
        return np.empty(0, np.uint64)
    escape = words == ESCAPE
    raw = np.r_[False, escape[:-1]]
    row = np.repeat(np.arange(blocks), np.diff(offsets.astype(np.int64)))
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in FIELDS])[selector]
    counts[raw] = 0
    before = np.cumsum(counts) - counts
    place = before - before[offsets[:-1].astype(np.int64)][row]
    out = np.zeros((blocks, BLOCK_IDS + _PAD), np.uint64)
    plain = ~raw & ~escape
    for s in np.unique(selector[plain]).tolist():
        count, bits = FIELDS[s]
        if bits:
            mine = np.flatnonzero(plain & (selector == s))
            fields = (words[mine, None] >> (np.arange(count) * bits).astype(np.uint64)) & np.uint64((1 << bits) - 1)
            out[row[mine, None], place[mine, None] + np.arange(count)] = fields
    big = np.flatnonzero(escape)
    out[row[big], place[big]] = words[big + 1]
    return out[:, :BLOCK_IDS].reshape(-1)[:n]


def write_segment(doc_ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words, offsets = pack(ids)
    body = b"".join([doc_ids.astype("<i8").tobytes(), nulls.astype("u1").tobytes(), lengths.astype("<u8").tobytes(), offsets.astype("<u4").tobytes(), words.astype("<u8").tobytes()])
    return _HEAD.pack(_MAGIC, len(doc_ids), len(ids), len(offsets) - 1, len(words), zlib.crc32(body)) + body


def read_segment(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, null flags, ids per document and all ids (uint64) of a segment."""
    magic, docs, n, blocks, words, crc = _HEAD.unpack_from(data)
    if magic != _MAGIC or zlib.crc32(memoryview(data)[_HEAD.size :]) != crc:
        raise ValueError("not a whole Simple-8b segment")
    at, parts = _HEAD.size, []
    for kind, count in (("<i8", docs), ("u1", docs), ("<u8", docs), ("<u4", blocks + 1), ("<u8", words)):
        parts.append(np.frombuffer(data, kind, count, at))
        at += parts[-1].nbytes
    return parts[0], parts[1], parts[2], unpack(parts[4], parts[3], n)


#: The normalizer and pre-tokenizer of tokenizers that words can be looked up for one by one.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def by_words(config: dict) -> bool:
    """Whether a tokenizer gives each word of a text the ids it gives the word alone, in lower case."""

    def apart(token: dict) -> bool:
        text = token["content"]
        return text.startswith("<|") and not any(c.isspace() for c in text) and not any(token[k] for k in ("single_word", "lstrip", "rstrip", "normalized"))

    same = config.get("normalizer") == _NORMALIZER and config.get("pre_tokenizer") == _PRE_TOKENIZER and config["model"]["type"] == "BPE" and not config["model"].get("dropout")
    return same and not config.get("truncation") and not config.get("padding") and all(map(apart, config.get("added_tokens") or []))


class TextEncoder:
    """Ids of whole texts as little-endian uint32 bytes, by any tokenizer of the library."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has its core
        self.tokenizer = Tokenizer.from_str(tokenizer_json)

    def encode(self, column: pa.Array) -> list[bytes]:
        """Ids of each text (null: empty) as little-endian uint32."""
        texts = [t or "" for t in column.to_pylist()]
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]


# Kinds of bytes of folded texts: white space, letters, signs but for the apostrophe, digits, anything else.
_SPACE, _LETTER, _SIGN, _DIGIT, _OTHER = range(5)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[0x09:0x0E] = ord(" ")
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[ord(" ")] = _SPACE
_KIND[ord("a") : ord("z") + 1] = _LETTER
_KIND[ord("0") : ord("9") + 1] = _DIGIT
_KIND[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'"]] = _SIGN


_FOLD_BYTES, _KIND_BYTES = _FOLD.tobytes(), _KIND.tobytes()  # what translate looks bytes up in faster than an index


class WordEncoder(TextEncoder):
    """The same by way of the texts' words, for tokenizers that ``by_words`` tells.

    Such a tokenizer parts letters, single digits and signs, but for words with an
    apostrophe; so runs of those are looked up, and other words as a whole.
    """

    def __init__(self, tokenizer_json: str):
        super().__init__(tokenizer_json)
        from tokenizers import Tokenizer

        # The same model for runs of lower-case letters or of signs, which need no normalising and no pattern.
        plain = json.loads(tokenizer_json) | {"normalizer": None, "added_tokens": []}
        by_space = {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}
        as_bytes = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        plain["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [by_space, as_bytes]}
        self.plain = Tokenizer.from_str(json.dumps(plain))
        self.order, self.sorted = np.empty(0, np.int64), np.empty(0, np.uint64)
        self._keep(np.empty(0, np.int64), pa.array([], pa.large_string()), np.empty(0, np.uint64), np.empty(0, np.int32), np.zeros(1, np.int64), np.empty(0, "<u4"))
        self.turn = 0

    def _keep(self, some: np.ndarray, strings: pa.Array, hashes: np.ndarray, used: np.ndarray, begin: np.ndarray, ids: np.ndarray) -> None:
        """Known words from now on: their strings, hashes, last use and ids (from ``begin`` on), all or ``some``."""
        if len(some):
            strings, hashes, used, size = strings.take(pa.array(some)), hashes[some], used[some], np.diff(begin)[some]
            place = np.repeat(begin[some] - (np.cumsum(size) - size), size)
            ids, begin = ids[place + np.arange(len(place))], np.r_[0, np.cumsum(size)]
        if len(some) or len(hashes) <= len(self.sorted):
            self.order = np.argsort(hashes, kind="stable")
            self.sorted = hashes[self.order]
        else:  # those that have come to the end are put among the others
            fresh = hashes[len(self.sorted) :]
            by_hash = np.argsort(fresh, kind="stable")
            at = np.searchsorted(self.sorted, fresh[by_hash], "right")
            self.order, self.sorted = np.insert(self.order, at, len(self.order) + by_hash), np.insert(self.sorted, at, fresh[by_hash])
        self.strings, self.hashes, self.used, self.begin, self.ids = strings, hashes, used, begin, ids

    def _encode_each(self, words: list[str], plain: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of all words in pieces, and how many each has."""
        ids, sizes = [], []
        for a in range(0, len(words), 4096):
            some = words[a : a + 4096]
            if plain:
                e = self.plain.encode(" ".join(some), add_special_tokens=False)
            else:
                e = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(e.ids, "<u4"))
            sizes.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(some)))
        return ids, sizes

    def _places(self, words: pa.Array, plain: np.ndarray) -> np.ndarray:
        """Numbers of distinct words that aren't empty among those known, which they are then; ``plain`` tells runs of letters, signs or digits.

        Words are found by a hash and compared as a whole.
        """
        self.turn += 1
        if len(self.hashes) > KNOWN_WORDS:
            self._keep(np.flatnonzero(self.used >= np.median(self.used)), self.strings, self.hashes, self.used, self.begin, self.ids)
        raw, offsets = text_buffers(words)
        hashes = span_hashes(raw[: offsets[-1]], offsets[:-1], offsets[1:])
        place, known = np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        if len(self.hashes):
            at = np.searchsorted(self.sorted, hashes)
            at[at == len(self.sorted)] = 0
            place = self.order[at]
            known = (self.sorted[at] == hashes) & pc.equal(words, self.strings.take(pa.array(place))).to_numpy(zero_copy_only=False)
        new = np.flatnonzero(~known)
        if len(new):
            new = np.r_[new[plain[new]], new[~plain[new]]]
            fresh, n = words.take(pa.array(new)), int(plain[new].sum())
            both = fresh.to_pylist()
            parts = [self._encode_each(both[:n], True), self._encode_each(both[n:], False)]
            place[new] = len(self.hashes) + np.arange(len(new))
            sizes = np.concatenate([x for _, s in parts for x in s])
            begin = np.r_[self.begin, self.begin[-1] + np.cumsum(sizes)]
            self._keep(new[:0], pa.concat_arrays([self.strings, fresh]), np.r_[self.hashes, hashes[new]], np.r_[self.used, np.zeros(len(new), np.int32)], begin, np.concatenate([self.ids, *(x for i, _ in parts for x in i)]))
        self.used[place] = self.turn
        return place

    def _gathered(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words by their numbers, one after the other, and where each word's begin."""
        size = np.diff(self.begin)[place]
        upto = np.r_[0, np.cumsum(size)]
        kind = np.int32 if max(upto[-1], len(self.ids)) < 1 << 31 else np.int64
        at = np.repeat((self.begin[place] - upto[:-1]).astype(kind), size)
        at += np.arange(upto[-1], dtype=kind)
        return self.ids[at], upto

    def _narrow_texts(self, raw: np.ndarray, offsets: np.ndarray) -> list[memoryview]:
        """Ids of texts below U+0100, where lower case is a change of bytes; each distinct run is looked up once."""
        data = np.frombuffer(bytearray(raw[offsets[0] : offsets[-1]]).translate(_FOLD_BYTES), np.uint8)
        bounds, n = offsets - offsets[0], int(offsets[-1] - offsets[0])
        if not n:
            return [memoryview(b"")] * (len(offsets) - 1)
        after = np.flatnonzero(data[:-1] == 0xC3) + 1
        capital = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]  # A-grave to Thorn, without the times sign
        data[capital] += 0x20
        kind = np.frombuffer(bytearray(data).translate(_KIND_BYTES), np.uint8)
        letter = after[(data[after] >= 0x9F) & (data[after] != 0xB7)]  # sharp s to y-diaeresis, without the division sign
        kind[letter] = kind[letter - 1] = _LETTER
        starts = np.unique(bounds[bounds < n])
        odd = np.flatnonzero(kind == _OTHER)
        if len(odd):  # all of their words
            gap = kind == _SPACE
            gap[starts] = True
            gaps = np.r_[np.flatnonzero(gap), n]
            word = np.searchsorted(gaps, odd, "right") - 1
            word = word[np.r_[True, word[1:] != word[:-1]]]
            begin, size = gaps[word], gaps[word + 1] - gaps[word]
            at = np.repeat(begin - (np.cumsum(size) - size), size)
            at += np.arange(len(at))
            kind[at[kind[at] != _SPACE]] = _OTHER
        turn = kind[1:] != kind[:-1]
        turn |= kind[1:] == _DIGIT
        turn = np.r_[True, turn]
        turn[starts] = True
        before = np.r_[0, np.cumsum(np.add.reduceat(kind != _SPACE, starts, dtype=np.int64))]
        kind |= turn.view(np.uint8) << 3
        data = np.frombuffer(data.tobytes().translate(None, b" "), np.uint8)  # white space goes
        kind = np.frombuffer(kind.tobytes().translate(None, bytes([_SPACE, _SPACE | 8])), np.uint8)
        turn, kind = kind >= 8, kind & 7
        bounds = before[np.searchsorted(starts, bounds)]
        edges = np.r_[np.flatnonzero(turn), len(data)]
        runs = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int64).tobytes()), pa.py_buffer(data)).dictionary_encode()
        at = runs.indices.to_numpy()
        plain = np.zeros(len(runs.dictionary), bool)
        plain[at] = kind[edges[:-1]] != _OTHER
        ids, upto = self._gathered(self._places(runs.dictionary, plain)[at])
        out = memoryview(ids.tobytes())
        ends = (4 * upto[np.searchsorted(edges, bounds)]).tolist()
        return [out[a:b] for a, b in zip(ends, ends[1:])]

    def _any_text(self, text: str) -> bytes:
        words = pa.array([w for w in text.replace("\n", " ").split(" ") if w], pa.large_string()).dictionary_encode()
        if not len(words):
            return b""
        distinct = words.dictionary
        return self._gathered(self._places(distinct, np.zeros(len(distinct), bool))[words.indices.to_numpy()])[0].tobytes()

    def encode(self, column: pa.Array) -> list[bytes]:
        """Ids of each text (null: empty) as little-endian uint32."""
        raw, offsets = text_buffers(column)
        data = raw[offsets[0] : offsets[-1]]
        special = data >= 0xC4
        special[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
        special = np.searchsorted(np.flatnonzero(special), offsets - offsets[0])
        odd = np.flatnonzero(np.diff(special)).tolist()  # with characters from U+0100 on, or with what may be an added token, whose case counts
        out: list[bytes] = []
        at = 0
        for i in [*odd, len(column)]:
            if i > at:
                out += self._narrow_texts(raw, offsets[at : i + 1])
            if i < len(column):
                out.append(self._any_text(column[i].as_py()))
            at = i + 1
        return out


_ENCODERS: dict[int, TextEncoder] = {}


def _encoder(tokenizer_json: str) -> TextEncoder:
    key = hash(tokenizer_json)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = (WordEncoder if by_words(json.loads(tokenizer_json)) else TextEncoder)(tokenizer_json)
    return _ENCODERS[key]


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, end_id: int | None = 2) -> None:
    """Write the ids of ``docs`` (doc_id, text, ...) in ascending doc_id order to ``path``.

    A null text counts as empty (only the end id, if there is one); null doc_ids
    come first; rows that repeat a doc_id follow each other by their text's hash.
    Ids are those of the tokenizers library without special tokens added.
    Other columns are ignored; an empty table gives files without segments.
    """
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        tokenizer = spark.sparkContext.broadcast(f.read())  # a tokenizer's file, of a size that is given
    ending = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer.value)
        piece, segment, base = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def out() -> pa.RecordBatch:
            nonlocal held, size, segment, base
            lengths = np.array([len(b) // 4 for _, b in held], np.uint64)
            ids = np.frombuffer(b"".join(b for _, b in held), "<u4").astype(np.uint64)
            data = write_segment(np.array([d or 0 for d, _ in held], np.int64), np.array([d is None for d, _ in held]), lengths, ids)
            row = pa.RecordBatch.from_pydict({"piece": pa.array([piece], pa.int32()), "segment": pa.array([segment], pa.int32()), "base": pa.array([base], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()), "data": pa.array([data], pa.binary())})
            held, size, segment, base = [], 0, segment + 1, base + len(ids)
            return row

        for batch in batches:
            _, offsets = text_buffers(batch.column(1))
            for a, b in slices(offsets, ENCODE_BYTES):
                for doc, ids in zip(batch.column(0).slice(a, b - a).to_pylist(), encoder.encode(batch.column(1).slice(a, b - a))):
                    held.append((doc, b"".join((ids, ending))))
                    size += len(held[-1][1]) // 4
                    if size >= SEGMENT_IDS:
                        yield out()
        if held:
            yield out()

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The text's hash parts rows without an id, or with one id, among partitions.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text").asc_nulls_first()]
    rows = rows.repartitionByRange(shuffle_width(spark), *order[:2]).sortWithinPartitions(*order)
    rows.mapInArrow(run, "piece int, segment int, base long, n_ids long, data binary").write.parquet(path)


def _starts(segments: DataFrame) -> dict[int, int]:
    """Ids before each piece; there are as many as the writer had partitions."""
    before, at = {}, 0
    for row in segments.groupBy("piece").agg(F.sum("n_ids").alias("n")).orderBy("piece").collect():
        before[row["piece"]] = at
        at += row["n"]
    return before


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (and the ids if asked for) per document, from the files."""
    segments = spark.read.schema("piece int, segment int, base long, n_ids long, data binary").parquet(path)
    before = _starts(segments)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, base, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                docs, nulls, lengths, ids = read_segment(data.as_py())
                lengths = lengths.astype(np.int64)
                ends = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                begins = ends - lengths
                out = {
                    "doc_id": pa.array(docs, pa.int64(), mask=nulls.astype(bool)),
                    "start": pa.array(begins + (before[piece] + base), pa.int64()),
                    "n_tokens": pa.array(lengths, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())], pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.array([ids[a:b].astype(np.int64) for a, b in zip(begins.tolist(), ends.tolist())], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return segments.select("piece", "base", "data").mapInArrow(run, schema)
