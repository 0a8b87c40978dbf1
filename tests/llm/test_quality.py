"""The quality model against the Kneser-Ney formula, its thresholds, and held-out labels."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from larkspur.llm import quality
from larkspur.llm.bytewise import slices, text_buffers

SYLLABLES = ["ta", "re", "mi", "so", "lan", "der", "ing", "tion"]


def shape(t):
    lower, upper = sum("a" <= c <= "z" for c in t), sum("A" <= c <= "Z" for c in t)
    size = len(t.encode())
    if not re.match(r"[^\W_]|[^\x00-\x7f]", t):
        kind = 0
    elif any(c in "0123456789" for c in t):
        kind = 1
    elif upper and not lower and size > 1:
        kind = 2
    elif upper == 1 and "A" <= t[0] <= "Z":
        kind = 3
    else:
        kind = 4 if upper else 5 if lower else 6
    return quality.SHAPE + kind * 4 + sum(size > x for x in quality.LENGTHS)


def tokens(text):
    return re.findall(r"(?:[A-Za-z0-9]|[^\x00-\x7f])+|[^\x20\x09-\x0dA-Za-z0-9\x80-\U0010ffff]+", re.sub("[0-9]", "0", text or ""))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="aBc9_é\n\t\x00.!😀 ", max_size=25), max_size=8))
def test_tokens(texts):
    raw, offsets = text_buffers(pa.array(texts, pa.string()))
    for a, b in slices(offsets, 24):
        got = quality.Tokens(raw, offsets[a : b + 1])
        want = [tokens(t) for t in texts[a:b]]
        assert np.diff(got.first).tolist() == [len(w) for w in want]
        assert got.shapes.tolist() == [shape(t) for w in want for t in w]
        flat = [t for w in want for t in w]
        assert len(set(got.hashes.tolist())) == len(set(flat)) and len(set(zip(got.hashes.tolist(), flat))) == len(set(flat))


class KneserNey:
    """Probabilities over numbers, straight from the formula."""

    def __init__(self, sequences, base):
        self.base, n = base, quality.ORDER
        self.orders = {n: {}}
        for s in sequences:
            for i in range(n - 1, len(s)):
                g = tuple(s[i - n + 1 : i + 1])
                self.orders[n][g] = self.orders[n].get(g, 0) + 1
        for k in range(n - 1, 0, -1):
            self.orders[k] = {}
            for g in self.orders[k + 1]:
                self.orders[k][g[1:]] = self.orders[k].get(g[1:], 0) + 1
        self.d = {k: self.discount(list(c.values())) for k, c in self.orders.items()}

    def discount(self, counts):
        n = [sum(c == i for c in counts) for i in range(5)]
        if not (n[1] and n[2]):
            return [0.5] * 3
        y = n[1] / (n[1] + 2 * n[2])
        d = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
        return [min(max(x, 0.05), m - 0.05) for x, m in zip(d, (1, 2, 3))]

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / self.base
        mine = {g: c for g, c in self.orders[k].items() if g[:-1] == gram[:-1]}
        below = self.p(gram[1:])
        if not mine:
            return below
        cost = {g: self.d[k][min(c, 3) - 1] for g, c in mine.items()}
        total = sum(mine.values())
        return (mine[gram] - cost[gram] if gram in mine else 0.0) / total + sum(cost.values()) / total * below


def prose(rng, words):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.choice([1, 1, 1, 2]))) + rng.choice(["", "", "", ",", "."]) for _ in range(words)).capitalize()


@pytest.mark.parametrize("head,shard", [(400_000, 1 << 20), (0, 40), (50, 60)])
def test_perplexity_is_the_formula(spark, monkeypatch, head, shard):
    monkeypatch.setattr(quality, "HEAD", head)
    monkeypatch.setattr(quality, "SHARD_GRAMS", shard)
    monkeypatch.setattr(quality, "PIECE_BYTES", 400)
    rng = random.Random(2)
    train = [prose(rng, rng.randint(1, 25)) for _ in range(40)] + ["", None, "ta TA 12!", "ta TA 12!"]
    vocabulary = {}
    for t in train:
        for x in tokens(t):
            vocabulary[x] = vocabulary.get(x, 0) + 1
    known = {x: i for i, x in enumerate(sorted(x for x, n in vocabulary.items() if n > 1))}
    number = lambda x: quality.WORD + known[x] if x in known else shape(x)
    padded = lambda t: [quality.START] * 2 + [number(x) for x in tokens(t)] + [quality.END]
    model = KneserNey([padded(t) for t in train if t], quality.WORD + len(known))
    every = [(g,) for g in range(quality.WORD + len(known))]
    assert sum(model.p(g) for g in every) == pytest.approx(1, abs=1e-6)
    trained, shards = quality.train(spark.createDataFrame([(t,) for t in train], "text string"))
    assert len(trained.vocabulary) == len(known) and len(trained.head) <= head
    texts = [prose(rng, rng.randint(1, 40)) for _ in range(30)] + train + ["xyzzy QUUX %%% é", "!", " ", None, "ta", "ta " * 3000]
    docs = quality._plain(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r for r in quality.log_perplexities(docs, trained, shards).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        s = padded(t)
        assert got[i]["n_tokens"] == len(s) - 3
        if len(s) == 3:
            assert got[i]["log_perplexity"] is None
        elif i != len(texts) - 1:
            want = -sum(math.log(model.p(tuple(s[j - 2 : j + 1]))) for j in range(2, len(s))) / (len(s) - 2)
            assert got[i]["log_perplexity"] == pytest.approx(want, abs=2e-5), t


def test_word_order_counts(spark):
    rng = random.Random(3)
    cycle = [f"word{i}" for i in range(60)]
    sentence = lambda: " ".join((cycle * 2)[(a := rng.randrange(60)) : a + 30]) + "."
    good = [" ".join(sentence() for _ in range(6)) for _ in range(200)]
    salads = [" ".join(rng.sample(t.split(), len(t.split()))) for t in good[:60]]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(good + salads)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60, 160)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in quality.judge(docs, labels).filter("kept").collect()}
    assert len(kept & set(range(200))) >= 196 and not kept & set(range(200, 260))


def test_held_out_labels(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(20, 120)) if i % 5 else "".join(rng.choices("#$%&*|!", k=200)) + prose(rng, 60).upper(), rng.choice(["en", "en", "fr", None])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(250)], "doc_id long, quality int, toxic int")
    judged = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    assert all(not judged[i]["kept"] for i in range(400) if i % 5 == 0)
    assert sum(judged[i]["kept"] for i in range(250, 400) if i % 5) >= 0.97 * 120
    kept = {r["doc_id"] for r in quality.keep_good(docs, labels).collect()}
    assert kept == {i for i, r in judged.items() if r["kept"]}


def test_thresholds_against_brute_force(spark):
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, prose(rng, rng.randint(1, 200)), rng.choice(["en", "fr", "de"])) for i in range(300)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    judged = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    held = {r["doc_id"] for r in quality.sampled_ids(labels).filter("held").collect()}
    up = lambda v: math.ceil(v / quality.GRID - 1e-9) * quality.GRID

    def quantile(values, q):
        v = sorted(values)
        return up(v[max(0, math.ceil(q * len(v) - 1e-9) - 1)])

    def drawn(groups, q):
        every = quantile([x for g in groups.values() for x in g], q)
        return {k: (len(g) * quantile(g, q) + quality.PRIOR * every) / (len(g) + quality.PRIOR) for k, g in groups.items()}, every

    rows = [judged[i] for i in held]
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r["lang"], []).append(r["log_perplexity"])
    centres, _ = drawn(by_lang, 0.5)
    assert set(centres) == {"en", "fr", "de"}
    scale = lambda r: math.sqrt(min(1, r["n_tokens"] / quality.LONG))
    limits, _ = drawn({k: [(r["log_perplexity"] - centres[k]) * scale(r) for r in rows if r["lang"] == k] for k in centres}, quality.QUANTILE)
    for r in judged.values():
        assert r["threshold"] == pytest.approx(centres[r["lang"]] + limits[r["lang"]] / scale(r), abs=1.1e-3)
        assert r["kept"] == (r["log_perplexity"] <= r["threshold"]) or abs(r["log_perplexity"] - r["threshold"]) < 2e-3


def test_no_trusted_text_and_own_columns(spark):
    docs = spark.createDataFrame([(1, "ta re mi", "en", "a", "b"), (2, "", None, "c", "d"), (None, None, "en", "e", "f")], "doc_id long, text string, lang string, key string, row string")
    labels = spark.createDataFrame([(9, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["kept"] for r in quality.judge(docs, labels).collect()} == {1: True, 2: False, None: False}
    kept = quality.keep_good(docs.withColumns({"key1": F.lit(1), "kept": F.lit("x")}), labels)
    assert [tuple(r) for r in kept.collect()] == [(1, "ta re mi", "en", "a", "b", 1, "x")]
