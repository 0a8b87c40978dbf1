"""Blocks compared in single precision first: scores and ranks stay those of the expressions, near ties too."""

import numpy as np
import pyarrow as pa
import pytest

from larkspur.operators import blocks


def _lists(a):
    flat = pa.array(a.reshape(-1))
    for size in reversed(a.shape[1:]):
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, size), pa.int32()), flat)
    return flat


def _best(kernel, vectors, k, step):
    ids = pa.array(np.arange(len(vectors)))
    batches = [pa.RecordBatch.from_arrays([ids[i : i + step], _lists(vectors[i : i + step])], ["doc_id", "vec"]) for i in range(0, len(vectors), step)]
    out = pa.Table.from_batches(list(blocks.best_rows(iter(batches), kernel, pa.array(np.arange(kernel.count)), k))).to_pylist()
    found = {}
    for r in out:
        found.setdefault(r["query_id"], []).append((-r["score"], r["doc_id"]))
    return {q: sorted(x)[:k] for q, x in found.items()}


@pytest.mark.parametrize("kind", ["cosine", "max_sim"])
def test_near_ties(monkeypatch, kind):
    monkeypatch.setattr(blocks, "BLOCK", 1 << 12)
    rng = np.random.default_rng(5)
    shape = (8,) if kind == "cosine" else (3, 8)
    base = rng.normal(size=(40, *shape))
    base /= np.linalg.norm(base, axis=-1, keepdims=True)
    # Copies that differ by less than single precision tells, and by a little more.
    vectors = np.concatenate([base + rng.choice([0.0, 1e-9, 1e-7, 1e-6, 3e-6], (40, *[1] * len(shape))) * rng.normal(size=base.shape) for _ in range(30)])
    queries = vectors[::13]
    if kind == "cosine":
        kernel = blocks.Cosine(_lists(queries))
        unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
        scores = unit(queries) @ unit(vectors).T
        assert kernel.matrix.dtype == np.float32
    else:
        kernel = blocks.MaxSim(_lists(queries))
        scores = np.einsum("qpd,vrd->qvpr", queries, vectors).max(axis=3).sum(axis=2)
    got = _best(kernel, vectors, 7, 500)
    assert kernel.sliced
    for q, row in enumerate(np.round(scores, 6)):
        want = sorted(zip((-row).tolist(), range(len(row))))[:7]
        assert [d for _, d in got[q]] == [d for _, d in want]
        np.testing.assert_allclose([s for s, _ in got[q]], [s for s, _ in want], atol=1e-12)
