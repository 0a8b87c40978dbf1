"""Limits of vector searches from a first look at all rows: same rows, few of them scored."""

import numpy as np
import pyarrow as pa
import pytest

from larkspur.operators.blocks import Cosine, MaxSim, best_rows


def _search(kernel, vectors, k, step, monkeypatch=None):
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(vectors))), pa.array(vectors)], ["doc_id", "vec"])
    count = 0
    inner = kernel.scores

    def scores(query, row):
        nonlocal count
        count += len(query)
        return inner(query, row)

    kernel.scores = scores
    out = best_rows((rows.slice(a, step) for a in range(0, len(rows), step)), kernel, pa.array(range(kernel.count)), k)
    got = [r for b in out for r in zip(*(c.to_pylist() for c in b.columns))]
    best = {}
    for q, d, s in sorted(got, key=lambda r: (r[0], -np.inf if r[2] is None else -r[2], r[1])):
        best.setdefault(q, []).append((d, s))
    return {q: b[:k] for q, b in best.items()}, count


@pytest.mark.parametrize("odd", [False, True])
@pytest.mark.parametrize("copies", [1, 3])
def test_few_rows_are_scored(odd, copies):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(24_000 // copies, 16)).tolist() * copies
    if odd:
        vectors[3], vectors[700], vectors[9000] = None, [0.0] * 16, [1.0, 2.0]
    queries = rng.normal(size=(60, 16)).tolist()
    asked = [None, *queries] if odd else queries
    got, scored = _search(Cosine(pa.array(asked, pa.list_(pa.float64()))), vectors, 20, 3000)
    if odd:
        vectors[3] = vectors[9000] = [0.0] * 16
        got.pop(0)
        got = {q - 1: b for q, b in got.items()}
    m, q = np.array(vectors), np.array(queries)
    size = np.linalg.norm(m, axis=1)
    value = np.round(q @ m.T / np.linalg.norm(q, axis=1)[:, None] / np.where(size > 0, size, 1), 6)
    for i in range(len(q)):
        want = sorted(range(len(m)), key=lambda d: (-value[i, d], d))[:20]
        assert [d for d, _ in got[i]] == want and np.allclose([s for _, s in got[i]], value[i, want], atol=2e-6)
    if not odd:
        assert scored < 60 * 20 * 2.5  # from the first 512 rows' limits it was over 60 * 20 * 4


def test_late_interaction_too():
    rng = np.random.default_rng(6)
    pages, asked = rng.normal(size=(12_000, 2, 4)), rng.normal(size=(30, 3, 4))
    got, scored = _search(MaxSim(pa.array(asked.tolist())), pages.tolist(), 10, 12_000)
    value = np.round(np.einsum("qpd,nad->qnpa", asked, pages).max(axis=3).sum(axis=2), 6)
    for i in range(30):
        assert [d for d, _ in got[i]] == sorted(range(12_000), key=lambda d: (-value[i, d], d))[:10]
    assert scored < 30 * 10 * 2.5


def test_only_queries_with_a_likely_row_are_compared_row_by_row(monkeypatch):
    rng = np.random.default_rng(7)
    compared, inner = 0, np.flatnonzero

    def flatnonzero(a):
        nonlocal compared
        compared += a.size
        return inner(a)

    monkeypatch.setattr(np, "flatnonzero", flatnonzero)
    _search(Cosine(pa.array(rng.normal(size=(60, 16)).tolist())), rng.normal(size=(24_000, 16)).tolist(), 5, 24_000)
    assert compared < 60 * 24_000 / 2
