"""Trigrams as they are shuffled: word by word, in fewer bytes than differences of whole trigrams."""

import numpy as np

from larkspur.llm import quality as Q


def test_packed_trigrams_come_back():
    rng = np.random.default_rng(1)
    edge = Q.IDS - 1
    sets = [[], [0], [edge << 36 | edge << 18 | edge], [0, 1, 1 << 18, (1 << 18) + 1, 1 << 36, edge << 36]]
    sets += [rng.integers(0, 1 << bits, n) for bits, n in ((54, 1), (54, 1000), (40, 5000), (20, 3000), (6, 500))]
    for keys in sets:
        keys = np.unique(np.asarray(keys, np.int64))
        np.testing.assert_array_equal(Q.unpack_grams(Q.pack_grams(keys), len(keys)), keys)


def test_packed_trigrams_of_text_are_smaller():
    rng = np.random.default_rng(2)
    words = np.minimum(rng.zipf(1.2, (3, 50_000)), Q.IDS - 1).astype(np.int64)
    keys = np.unique(words[0] << 36 | words[1] << 18 | words[2])
    assert len(Q.pack_grams(keys)) < 0.9 * len(Q.squeeze(np.diff(keys, prepend=0)))
