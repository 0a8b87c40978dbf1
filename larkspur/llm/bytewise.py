"""Words and shingles of many texts at once, as array operations on their UTF-8 bytes.

A batch of texts is taken as one byte array with offsets, as Arrow holds it.
Every byte is visited a fixed number of times by vectorised code; nothing is
done per character in Python.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Texts handled at once; bounds the arrays a worker holds, a longer text is handled alone.
SLICE_BYTES = 1 << 19


def byte_table(separators: bytes, lower: bool = True) -> np.ndarray:
    """256 byte classes: 0 for a separator, else the (lower-cased ASCII) byte itself, or FF, which no text holds, for byte 0."""
    table = np.arange(256, dtype=np.uint8)
    table[0] = 0xFF
    if lower:
        table[ord("A") : ord("Z") + 1] += 32
    table[list(separators)] = 0
    return table


#: Words as runs of anything but space and the controls 9 to 13; A-Z lower-cased.
SPACED_WORDS = byte_table(bytes([0x20, *range(0x09, 0x0E)]))
#: Words as runs of ASCII letters, digits, underscore and all non-ASCII characters.
PLAIN_WORDS = byte_table(bytes(b for b in range(128) if not (chr(b).isalnum() or b == 0x5F)))


def _trimmer() -> Callable[[int], int] | None:
    """The C library's way to give free memory back, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return None


_TRIM = _trimmer()


def give_back() -> None:
    """Returns memory that is free but held to the system, at the end of a task: workers live on beside the next stage's."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty.

    What Arrow has kept of earlier batches goes back to the system first: workers
    live long, and their memory counts beside the executor's.
    """
    pa.default_memory_pool().release_unused()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw, ends


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text is a range of its own."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        upto = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        upto = min(max(upto, row + 1), rows)
        yield row, upto
        row = upto


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SLICE_BYTES)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def word_spans(classes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-zero classes, cut at the texts' bounds."""
    n = len(classes)
    word = classes != 0
    before = np.empty(n, dtype=bool)
    after = np.empty(n, dtype=bool)
    if n:
        before[0] = after[-1] = False
        before[1:] = word[:-1]
        after[:-1] = word[1:]
        inner = bounds[(bounds > 0) & (bounds < n)]
        before[inner] = False
        after[inner - 1] = False
    return np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1


def span_hashes(classes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, from one running polynomial sum."""
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _powers(len(classes))
    total = np.cumsum((classes.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)
    left = total[starts] - (classes[starts].astype(np.uint64) + np.uint64(1)) * up[starts]
    h = (total[ends - 1] - left) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


class Words:
    """The words of a range of texts: ``hashes`` with ``first[d]:first[d + 1]`` for text ``d``."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        bounds = offsets - offsets[0]
        classes = table[raw[offsets[0] : offsets[-1]]]
        self.starts, self.ends = word_spans(classes, bounds)
        self.hashes = span_hashes(classes, self.starts, self.ends)
        self.first = np.searchsorted(self.starts, bounds)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words of one array (runs across texts are the caller's to skip)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h = (h + words[j : j + n]) * np.uint64(0xFF51AFD7ED558CCD) + np.uint64(2 * j + 1)
        h ^= h >> np.uint64(29)
    return mix(h)


def sequence_hash(words: np.ndarray) -> np.uint64:
    """One hash of a whole short sequence, apart from those of runs of a fixed length."""
    h = np.array([0x2545F4914F6CDD1D + len(words)], np.uint64)
    for w in words:
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + w)
    return h[0]


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """Per text its sorted distinct shingle hashes.

    Fewer words than ``size`` make one shingle of the whole sequence; no words make none.
    """
    runs = shingle_hashes(words.hashes, size)
    sets = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= size:
            sets.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            sets.append(np.array([sequence_hash(words.hashes[a:b])], np.uint64))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets
