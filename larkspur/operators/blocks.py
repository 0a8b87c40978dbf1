"""Best k of a batch of queries over blocks of rows: what a task of a vector search does.

Matrix products tell which pairs may be among a query's best; those alone are scored
term by term in the order of the expressions in ``larkspur.functions.vectors``, and
rounded as Spark rounds.  So scores and ranks are those of the expressions for all
pairs, nulls, NaN and vectors of other lengths among them.  A task holds k rows per
query, and hands them on when its rows end.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Products that are held at once, and pairs that are scored at once.
PRODUCTS = 1 << 22
#: Products that are compared with limits at once, which a core's cache holds, and rows of these blocks.
BLOCK, BLOCK_ROWS = 1 << 19, 512
PAIRS = 1 << 18
#: Bytes of rows that are met at once, and groups of such a block's rows whose largest products tell limits.
GATHERED, GROUPS = 1 << 25, 8
#: Scores that differ by less may change places when they are rounded to six digits.
MARGIN = 1.2e-6
#: A rounding in single precision, in which vectors of moderate size are compared first.
EPS = 2.0**-24
NULL, NUMBER, NAN = 0, 1, 2
_STEP, _WIDE = Decimal("1e-6"), Context(prec=400)


def rounded(x: np.ndarray) -> np.ndarray:
    """Six decimal places, halves away from zero by the shortest decimal form, as Spark's ``round``."""
    with np.errstate(invalid="ignore", over="ignore"):
        size = np.abs(x) * 1e6
        low = np.floor(size)
        out = np.copysign((low + (size - low >= 0.5)) / 1e6, x) + 0.0
        close = (np.abs(size - low - 0.5) <= 1e-6) | (size > 1e8)
    out[~np.isfinite(x)] = x[~np.isfinite(x)]
    for i in np.flatnonzero(close & np.isfinite(x)).tolist():
        out[i] = float(Decimal(repr(float(x[i]))).quantize(_STEP, ROUND_HALF_UP, _WIDE)) + 0.0
    return out


class Vectors:
    """A column of vectors, padded with zeros; ``bad`` ones are null or hold a null."""

    def __init__(self, column: pa.Array):
        offsets = column.offsets.to_numpy().astype(np.int64)
        flat = column.values.cast(pa.float64())
        nulls = np.r_[0, np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))]
        flat = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
        missing = column.is_null().to_numpy(zero_copy_only=False)
        self.lengths = np.where(missing, 0, np.diff(offsets))
        self.bad = missing | (nulls[offsets[1:]] > nulls[offsets[:-1]])
        self.padded = np.zeros((len(column), int(self.lengths.max(initial=0))))
        row = np.repeat(np.arange(len(column)), self.lengths)
        place = np.arange(len(row)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.padded[row, place] = flat[offsets[:-1][row] + place]
        self.columns = np.ascontiguousarray(self.padded.T)
        every = np.arange(len(column))
        with np.errstate(all="ignore"):
            self.norms = np.sqrt(dots(self, every, self, every))

    def usual(self) -> int:
        """The most frequent length."""
        return int(np.bincount(self.lengths).argmax()) if len(self.lengths) else 0

    def even(self, length: int) -> np.ndarray:
        """Whether each one has this length and components that products can take without care."""
        fine = (self.norms == 0) | ((self.norms > 1e-100) & (self.norms < 1e100))
        return ~self.bad & (self.lengths == length) & fine

    def matrix(self, length: int) -> np.ndarray:
        if self.padded.shape[1] >= length:
            return self.padded[:, :length]
        return np.pad(self.padded, ((0, 0), (0, length - self.padded.shape[1])))


def dots(a: Vectors, i: np.ndarray, b: Vectors, j: np.ndarray) -> np.ndarray:
    """Dot products of pairs, summed up component by component."""
    out = np.zeros(len(i))
    for begin in range(0, len(i), PAIRS):
        x, y, total = i[begin : begin + PAIRS], j[begin : begin + PAIRS], out[begin : begin + PAIRS]
        for left, right in zip(a.columns, b.columns):
            total += left[x] * right[y]
    return out


class Cosine:
    """``vectors.cosine`` of rows and queries."""

    sliced = True  # some queries may be compared at a time

    def __init__(self, queries: pa.Array):
        self.queries = Vectors(queries)
        self.count = len(queries)
        self.length = self.queries.usual()
        self.matrix, self.odd = self._units(self.queries)

    def _units(self, v: Vectors) -> tuple[np.ndarray, np.ndarray]:
        even = v.even(self.length)
        units = np.where((even & (v.norms > 0))[:, None], v.matrix(self.length), 0.0) / np.where(even & (v.norms > 0), v.norms, 1.0)[:, None]
        return units.astype(np.float32), ~even & ~v.bad

    def take(self, column: pa.Array) -> None:
        self.rows = Vectors(column)
        self.units, self.odd_rows = self._units(self.rows)

    def most_rows(self) -> int:
        return BLOCK_ROWS

    def likely(self, begin: int, end: int, first: int, last: int) -> np.ndarray:
        """Scores of some queries and some rows but for a tiny error; NaN where only ``scores`` tells."""
        out = self.matrix[first:last] @ self.units[begin:end].T
        if self.odd[first:last].any():
            out[self.odd[first:last]] = np.nan
        if self.odd_rows[begin:end].any():
            out[:, self.odd_rows[begin:end]] = np.nan
        return out

    def slack(self) -> float:
        """Single precision errs by at most this in a product of unit vectors, in the limits as well."""
        return MARGIN + 4 * (self.length + 8) * EPS

    def scores(self, query: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.rows, self.queries
        with np.errstate(all="ignore"):
            size = a.norms[row] * b.norms[query]
            value = dots(a, row, b, query) / size
        told = (size > 0) | np.isnan(size)
        zero = a.bad[row] | b.bad[query] | ~told
        value[zero] = 0.0
        kind = np.where(zero, NUMBER, np.where(a.lengths[row] != b.lengths[query], NULL, np.where(np.isnan(value), NAN, NUMBER)))
        return kind, value


class MaxSim:
    """``vectors.max_sim`` of queries' parts and rows' patches."""

    def __init__(self, queries: pa.Array):
        self.count = len(queries)
        self.null, self.first, self.parts = self._nested(queries)
        self.length = self.parts.usual()
        sizes = np.diff(self.first)
        uneven = np.r_[0, np.cumsum(~self.parts.even(self.length))]
        self.even = (sizes > 0) & (uneven[self.first[1:]] == uneven[self.first[:-1]]) & ~self.null
        self.used = np.flatnonzero(np.repeat(self.even, sizes))
        self.starts = np.cumsum(sizes[self.even]) - sizes[self.even]
        self.matrix = self.parts.matrix(self.length)[self.used]
        #: Parts of each query where all have as many, else 0.
        self.each = int(sizes[0]) if len(sizes) and self.even.all() and (sizes == sizes[0]).all() else 0
        self.by_part = [np.ascontiguousarray(self.matrix[i :: self.each], np.float32) for i in range(self.each)]

    @staticmethod
    def _nested(column: pa.Array) -> tuple[np.ndarray, np.ndarray, Vectors]:
        null = column.is_null().to_numpy(zero_copy_only=False)
        if null.any():
            column = pc.if_else(column.is_null(), pa.scalar([], column.type), column)
        offsets = column.offsets.to_numpy().astype(np.int64)
        inner = column.values.slice(offsets[0], offsets[-1] - offsets[0])
        return null, offsets - offsets[0], Vectors(inner)

    def take(self, column: pa.Array) -> None:
        self.null_rows, self.first_patch, self.patches = self._nested(column)
        uneven = np.r_[0, np.cumsum(~self.patches.even(self.length))]
        self.even_rows = (np.diff(self.first_patch) > 0) & (uneven[self.first_patch[1:]] == uneven[self.first_patch[:-1]])
        self.patch_matrix = self.patches.matrix(self.length)
        sizes = np.diff(self.first_patch)
        regular = self.each and len(sizes) and self.even_rows.all() and (sizes == sizes[0]).all() and self._single() < 1e-3 and max(self.parts.norms.max(), self.patches.norms.max()) < 1e30
        self.sliced = bool(regular)
        self.by_patch = [np.ascontiguousarray(self.patch_matrix[i :: sizes[0]], np.float32) for i in range(sizes[0])] if regular else []

    def _top(self) -> float:
        """The largest product of norms, times the parts of a query."""
        top = lambda v: v.norms[v.even(self.length)].max(initial=0.0)
        return top(self.parts) * top(self.patches) * np.diff(self.first).max(initial=0)

    def _single(self) -> float:
        """How far single precision may be off, in the limits as well."""
        return 4 * (self.length + self.each + 8) * EPS * self._top()

    def most_rows(self) -> int:
        if self.sliced:
            return BLOCK_ROWS
        each = max(1, len(self.used)) * max(1, -(-len(self.patch_matrix) // max(1, len(self.null_rows))))
        return max(1, PRODUCTS // max(each, self.count))

    def likely(self, begin: int, end: int, first: int, last: int) -> np.ndarray:
        """Some queries where parts and patches are regular, else all of them."""
        if self.sliced:
            out, best, product = (np.empty((last - first, end - begin), np.float32) for _ in range(3))
            for i, part in enumerate(self.by_part):
                target = best if i else out
                for j, patch in enumerate(self.by_patch):
                    np.matmul(part[first:last], patch[begin:end].T, out=product if j else target)
                    if j:
                        np.maximum(target, product, out=target)
                if i:
                    out += best
            return out
        out = np.full((self.count, end - begin), np.nan)
        rows = np.flatnonzero(self.even_rows[begin:end])
        if len(rows) and len(self.used):
            sizes = np.diff(self.first_patch)[begin + rows]
            starts = np.cumsum(sizes) - sizes
            patches = np.repeat(self.first_patch[begin + rows] - starts, sizes) + np.arange(sizes.sum())
            products = self.matrix @ self.patch_matrix[patches].T
            best = np.maximum.reduceat(products, starts, axis=1)
            out[np.ix_(np.flatnonzero(self.even), rows)] = np.add.reduceat(best, self.starts, axis=0)
        return out

    def slack(self) -> float:
        return MARGIN + (self._single() if self.sliced else 1e-12 * self._top())

    def scores(self, query: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind, value = np.empty(len(query), np.int64), np.zeros(len(query))
        n_parts, n_patches = np.diff(self.first)[query], np.diff(self.first_patch)[row]
        ends = np.cumsum(n_parts * np.maximum(n_patches, 1))
        begin = 0
        while begin < len(query):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, "right")))
            kind[begin:end], value[begin:end] = self._some(query[begin:end], row[begin:end], n_parts[begin:end], n_patches[begin:end])
            begin = end
        return kind, value

    def _some(self, query: np.ndarray, row: np.ndarray, n_parts: np.ndarray, n_patches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pair = np.repeat(np.arange(len(query)), n_parts)
        part = self.first[query][pair] + np.arange(len(pair)) - (np.cumsum(n_parts) - n_parts)[pair]
        many = n_patches[pair]
        at = np.repeat(np.arange(len(pair)), many)
        patch = self.first_patch[row][pair][at] + np.arange(len(at)) - (np.cumsum(many) - many)[at]
        with np.errstate(all="ignore"):
            product = dots(self.parts, part[at], self.patches, patch)
        fits = ~self.parts.bad[part[at]] & ~self.patches.bad[patch] & (self.parts.lengths[part[at]] == self.patches.lengths[patch])
        best, known = np.full(len(pair), -np.inf), np.zeros(len(pair), bool)
        with np.errstate(all="ignore"):
            np.maximum.at(best, at[fits], product[fits])
            known[at[fits]] = True
            value = np.bincount(pair, weights=np.where(known, best, 0.0), minlength=len(query))
        null = self.null[query].copy()
        null[pair[~known]] = True
        return np.where(null, NULL, np.where(np.isnan(value), NAN, NUMBER)), value


class Bm25:
    """BM25 of rows' terms for queries' weights per term."""

    floor = MARGIN + 4e-7  # what rounds to 0 doesn't count
    sliced = False

    def __init__(self, count: int, terms: pa.Array, first: np.ndarray, query: np.ndarray, weight: np.ndarray, avgdl: float, k1: float, b: float):
        self.count, self.terms, self.first, self.query, self.weight = count, terms, first, query, weight
        self.avgdl, self.k1, self.b = avgdl, k1, b

    def take(self, column: pa.Array) -> None:
        self.row, self.term, tf, length = term_counts(column, self.terms)
        self.share = tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length[self.row] / self.avgdl))
        self.begin = np.searchsorted(self.row, np.arange(len(column) + 1))
        self.many = self.first[self.term + 1] - self.first[self.term]

    def most_rows(self) -> int:
        return max(1, PRODUCTS // max(self.count, int(self.many.sum() // max(1, len(self.begin) - 1)), 1))

    def likely(self, begin: int, end: int, first: int, last: int) -> np.ndarray:
        """All queries at once, whatever is asked for."""
        a, z = self.begin[begin], self.begin[end]
        many = self.many[a:z]
        at = np.repeat(np.arange(z - a), many)
        post = (self.first[self.term[a:z]] - (np.cumsum(many) - many))[at] + np.arange(len(at))
        place = self.query[post] * (end - begin) + (self.row[a:z] - begin)[at]
        self.offset, self.block = begin, np.bincount(place, weights=self.share[a:z][at] * self.weight[post], minlength=self.count * (end - begin)).reshape(self.count, end - begin)
        return self.block

    def slack(self) -> float:
        return MARGIN

    def scores(self, query: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.full(len(query), NUMBER), self.block[query, row - self.offset]


def term_counts(column: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, number of a term, how often it comes there; and the number of all terms of each row, of lists of terms or of their numbers (-1: none)."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(offsets)
    words = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    number = (words if pa.types.is_integer(words.type) else pc.index_in(words, value_set=terms).fill_null(-1)).to_numpy().astype(np.int64)
    known = number >= 0
    key, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes)[known] * max(1, len(terms)) + number[known], return_counts=True)
    return key // max(1, len(terms)), key % max(1, len(terms)), tf, sizes


def _places(ids: pa.Array) -> np.ndarray | None:
    """Places in the order of the ids, nulls first; None where their order is Spark's own matter."""
    if pa.types.is_floating(ids.type) or pa.types.is_nested(ids.type):
        return None
    try:
        return pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="min").to_numpy().astype(np.int64)
    except (pa.ArrowNotImplementedError, pa.ArrowInvalid, KeyError):
        return None


class Best:
    """The best k rows of each query so far; rows that tie with the last of them in score and id stay too."""

    def __init__(self, queries: int, k: int, floor: float = -np.inf):
        self.k, self.limits, self.told = k, np.full(queries, floor), False
        self.query, self.kind, self.value = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.rows: pa.Table | None = None
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table]] = []
        self.waiting = 0

    def add(self, query: np.ndarray, kind: np.ndarray, value: np.ndarray, rows: pa.Table) -> None:
        self.held.append((query, kind, value, rows))
        self.waiting += len(query)
        if self.waiting >= max(1 << 16, len(self.limits) * self.k):
            self.merge()

    def merge(self) -> None:
        if not self.held:
            return
        queries, kinds, values, tables = zip(*self.held)
        self.held, self.waiting = [], 0
        query, kind, value = np.concatenate([self.query, *queries]), np.concatenate([self.kind, *kinds]), np.concatenate([self.value, *values])
        rows = pa.concat_tables([*([] if self.rows is None else [self.rows]), *tables])
        value = np.where(kind == NUMBER, value, 0.0)
        place = _places(rows.column(0).combine_chunks())
        place = np.zeros(len(query), np.int64) if place is None else place
        order = np.lexsort((place, -value, -kind, query))
        query, kind, value, place = query[order], kind[order], value[order], place[order]
        begin = np.searchsorted(query, query)
        rank = np.arange(len(query)) - begin
        last = np.minimum(begin + self.k - 1, len(query) - 1)
        stay = (rank < self.k) | ((kind == kind[last]) & (value == value[last]) & (place == place[last]))
        full, self.told = rank == self.k - 1, True
        self.limits[query[full]] = np.where(kind[full] == NUMBER, value[full], np.where(kind[full] == NAN, np.inf, -np.inf))
        self.query, self.kind, self.value = query[stay], kind[stay], value[stay]
        self.rows = rows.take(pa.array(order[stay])).combine_chunks()

    def raise_limits(self, kernel: Cosine | MaxSim, rows: int, step: int) -> None:
        """Limits from a first look at all rows: of the largest scores of groups of rows, k rows have at least the k-th.

        So few rows but the best are scored, while limits that come from the first
        rows alone let many pass.
        """
        many = max(1, BLOCK // min(step, rows))
        for first in range(0, kernel.count, many):
            last, tops = min(first + many, kernel.count), []
            for begin in range(0, rows, step):
                top = kernel.likely(begin, min(begin + step, rows), first, last)
                while top.shape[1] > GROUPS:
                    half = top.shape[1] // 2
                    rest = top[:, 2 * half :]
                    top = np.maximum(top[:, :half], top[:, half : 2 * half])
                    if rest.shape[1]:
                        top[:, :1] = np.maximum(top[:, :1], rest)
                tops.append(top)
            tops = np.concatenate(tops, axis=1)
            tops[np.isnan(tops)] = -np.inf
            sure = np.partition(tops, tops.shape[1] - self.k, axis=1)[:, tops.shape[1] - self.k]
            self.limits[first:last] = np.maximum(self.limits[first:last], sure)
        self.told = True

    def batches(self, ids: pa.Array) -> Iterator[pa.RecordBatch]:
        self.merge()
        if self.rows is None:
            return
        value = np.where(self.kind == NAN, np.nan, self.value)
        score = pa.array(value, pa.float64(), mask=self.kind == NULL)
        out = pa.Table.from_arrays([ids.take(pa.array(self.query)), *self.rows.columns, score], ["query_id", *self.rows.column_names, "score"])
        yield from out.combine_chunks().to_batches(50_000)


def meet(best: Best, kernel: Cosine | MaxSim | Bm25, batch: pa.RecordBatch) -> None:
    """Puts what may be among the best of a batch of rows, of which the last column is compared, to the best so far."""
    rows = pa.Table.from_batches([batch]).select(range(batch.num_columns - 1))
    kernel.take(batch.column(batch.num_columns - 1))
    step, slack, k = kernel.most_rows(), kernel.slack(), best.k
    if kernel.sliced and not best.told and GROUPS * (batch.num_rows // step) >= 4 * k:
        best.raise_limits(kernel, batch.num_rows, step)
    for begin in range(0, batch.num_rows, step):
        end = min(begin + step, batch.num_rows)
        untold = not best.told and end - begin >= k
        many = max(1, BLOCK // (end - begin)) if kernel.sliced else max(1, kernel.count)
        for first in range(0, kernel.count, many):
            last = min(first + many, kernel.count)
            likely = kernel.likely(begin, end, first, last)
            limits = best.limits[first:last]
            if untold:
                sure = np.where(np.isnan(likely), -np.inf, likely)
                limits = np.maximum(limits, np.partition(sure, end - begin - k, axis=1)[:, end - begin - k])
            limits = (limits - slack).astype(likely.dtype)
            some = np.flatnonzero(~(likely.max(axis=1) < limits))  # queries with any row that may be among the best; NaN stays
            at = np.flatnonzero(~(likely[some] < limits[some, None]))
            if len(at):
                query, row = some[at // (end - begin)] + first, at % (end - begin)
                kind, value = kernel.scores(query, row + begin)
                best.add(query, kind, rounded(value), rows.take(pa.array(row + begin)))


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of ``GATHERED`` bytes or a little more."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= GATHERED:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def best_rows(batches: Iterator[pa.RecordBatch], kernel: Cosine | MaxSim | Bm25, ids: pa.Array, k: int) -> Iterator[pa.RecordBatch]:
    """query_id, the rows' columns but for the last, and score; the first column orders rows of equal score, the last is compared."""
    best = Best(kernel.count, k, getattr(kernel, "floor", -np.inf))
    for batch in gathered(batches):
        meet(best, kernel, batch)
    yield from best.batches(ids)
