"""Known words of the token encoder: new ones are put among them, and all are found."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from larkspur.llm import tokenstore


def test_new_words_are_put_among_the_sorted(monkeypatch):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        config = f.read()
    encoder, plain = tokenstore.WordEncoder(config), tokenstore.TextEncoder(config)
    most, inner = 0, np.argsort

    def argsort(a, *args, **kw):
        nonlocal most
        most = max(most, len(a))
        return inner(a, *args, **kw)

    monkeypatch.setattr(np, "argsort", argsort)
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdeéß'7-"), rng.integers(1, 9)))
    for _ in range(6):
        texts = pa.array([" ".join(word() for _ in range(60)) + rng.choice(["", "\n", " don't  A'b\tC"]) for _ in range(20)] + [None, "", " ", "Été'x Don't <|a|> 漢字 1'"])
        assert [bytes(b) for b in encoder.encode(texts)] == plain.encode(texts)
    assert (np.diff(encoder.sorted.astype(object)) >= 0).all() and (encoder.sorted == encoder.hashes[encoder.order]).all()
    assert sorted(encoder.order.tolist()) == list(range(len(encoder.hashes)))
    assert most < len(encoder.hashes) / 2  # all known words used to be sorted anew for each few new ones
