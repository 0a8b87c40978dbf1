"""Operators that SQL can't express, against brute force."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction
from html import unescape

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from larkspur.llm import decontam, hamming, htmlmain, licenses, neardup, secretscan, tokenstore, urlrules
from larkspur.llm.bytewise import PLAIN_WORDS, SPACED_WORDS, Words, shingle_sets, slices, text_buffers
from larkspur.llm.mixing import mixture

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB cé\n\t\x0b\x00\x01😀", max_size=30), max_size=8))
def test_shingle_sets_have_the_right_sizes_and_overlaps(texts):
    raw, offsets = text_buffers(pa.array(texts, pa.string()))
    got = [s for a, b in slices(offsets, 16) for s in shingle_sets(Words(raw, offsets[a : b + 1], SPACED_WORDS), 2)]
    want = []
    for t in texts:
        w = WORD.findall(low(t))
        want.append({tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set())
    assert [len(s) for s in got] == [len(s) for s in want]
    for i in range(len(texts)):
        for j in range(i):
            assert len(set(got[i].tolist()) & set(got[j].tolist())) == len(want[i] & want[j])


def near_texts(rng):
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(n)] for n in (4, 5, 8, 30, 60, 120, 300)]
    out = []
    for b in base:
        for _ in range(14):
            w = list(b)
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                w = w[: max(1, len(w) - rng.randint(0, 3))]
            out.append(" ".join(w))
    rng.shuffle(out)
    return out + [None, "", " ", "one", "ONE", "two words", "Two  words"]


def components(texts, size, percent):
    sets = {}
    for i, t in enumerate(texts):
        w = WORD.findall(low(t))
        sets[i] = {tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    having: dict = {}
    for i in sets:
        shared: dict = {}
        for g in sets[i]:
            for j in having.get(g, ()):
                shared[j] = shared.get(j, 0) + 1
            having.setdefault(g, []).append(i)
        for j, both in shared.items():
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("size,small", [(4, 32), (5, 0)])
def test_near_duplicates(spark, monkeypatch, size, small):
    """small = 0 sends every bucket the way of large ones, in blocks of two."""
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "BLOCK", 256 if small else 2)
    texts = near_texts(random.Random(11))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, size, 80).collect()}
    assert got == components(texts, size, 80)


def test_blocks_that_are_dense_and_those_that_are_not(spark, monkeypatch):
    """Families of texts below the threshold that share a band by force, among some links."""
    monkeypatch.setattr(neardup, "SMALL", 0)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng = random.Random(7)
    texts = []
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(150)]
        for i in range(24):
            w = list(base)
            for _ in range((4, 11, 30)[family]):
                w[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, 4, 80).collect()}
    assert got == components(texts, 4, 80)


def test_recall_on_the_test_tables(spark):
    """All links of brute force over distinct sets, by an inverted index of shingles."""
    import os

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(texts)
    want = components([texts[i] for i in ids], 4, 80)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, 4, 80).collect()}
    assert got == {ids[i]: (n, ids[c]) for i, (n, c) in want.items()}


def test_registers_estimate_the_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        n = 4000
        common = rng.integers(0, 1 << 63, int(n * share), dtype=np.uint64)
        rest = [rng.integers(0, 1 << 63, n - len(common), dtype=np.uint64) for _ in range(2)]
        a, b = (np.unique(np.concatenate([common * np.uint64(2), r * np.uint64(2) + np.uint64(1)])) for r in rest)
        true = len(common) / (2 * n - len(common))
        ra, rb = neardup.registers([a, b])
        assert abs(neardup.estimate((ra == rb).mean()) - true) < 0.15
    assert (neardup.registers([np.empty(0, np.uint64)]) == 0xFFFF).all()
    assert (neardup.registers([np.array([5], np.uint64)]) == neardup.registers([np.array([5], np.uint64)])).all()


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "doc_id long, partner long")
    got = {r["doc_id"]: r["root"] for r in neardup.components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == 100


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70_000), st.integers(0, (1 << 63) - 1)), max_size=1500))
def test_simple8b_round_trip(ids):
    array = np.array(ids, np.uint64)
    words, offsets = tokenstore.pack(array)
    assert tokenstore.unpack(words, offsets, len(ids)).tolist() == ids


def test_token_files(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["Hello, WORLD! it's", None, "", "don't 12 ab  cd\n\nx,.y", "é́ ΣΑΣ İx ﬁ ½ <|endoftext|> z", "word " * 3000, "a\x1cb\tc", "<|ENDOFTEXT|>", "x<|EndOfText|>. É", "A<|endoftext|>B"]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    file = public_tokenizers.path("word_bpe_49k.json")
    path = str(tmp_path / "t")
    tokenstore.write_tokens(spark.createDataFrame(rows[::-1], "doc_id long, text string"), path, file, 2)
    got = {r["doc_id"]: r for r in tokenstore.read_tokens(spark, path, with_ids=True).collect()}
    tokenizer, at = Tokenizer.from_file(file), 0
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids"]) == (at, len(ids), ids)
        assert got[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_encoders_against_the_library():
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(3)
    parts = ["<|ENDOFTEXT|>", "<|endoftext|>", "<|EndOfText|>", "x", "The", " ", ".", "É", "e\u0301", "\n", "'S", "'s", " it's", "<", "|", "|>", "12", "\xa0", "\u0085", "İ", "ΑΣ", "ﬁ", "\x00", "\t", "ß", "ẞ", "中文", "µ", "ÿ", "Ÿ"]
    for name, fast in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            config = f.read()
        assert tokenstore.by_words(json.loads(config)) is fast
        encoder, library = tokenstore._encoder(config), Tokenizer.from_str(config)
        texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(1500)]
        got = [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(pa.array(texts))]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_damaged_segments_are_refused():
    data = bytearray(tokenstore.write_segment(np.array([1]), np.array([False]), np.array([3], np.uint64), np.array([1, 2, 3], np.uint64)))
    data[-1] ^= 1
    with pytest.raises(ValueError):
        tokenstore.read_segment(bytes(data))


def test_secrets(spark):
    rng = random.Random(4)
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    parts = ["token", "=", ":", " ", "secret", "PassWord", '"', "abcdefghijkl", "AKIA", "ABCDEFGHIJKLMNOP", "deadbeefdeadbeef", "é", "😀", "api_key", "apikey", "\n", "x-", "0f"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(150)]
    key = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=40))
    texts += [f"see {key} here", "averyordinarylongwordwithoutanysecretsinside", "SOME_LONG_CONSTANT_NAME_IN_CODE_2", "1234567890" * 5, "ab" * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in secretscan.secret_report(docs).collect()}
    for i, t in enumerate(texts):
        spans = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), t
        assert got[i]["n_assign"] == sum(k == "assign" for *_, k in spans)
    assert got[150]["spans"] == "random:4:44"
    assert all(got[i]["n_random"] == 0 for i in range(151, 155))


def secret_recall(spark, alphabet, n, tokens=60):
    rng = random.Random(n)
    docs = spark.createDataFrame([(i, "".join(rng.choices(alphabet, k=n))) for i in range(tokens)], "doc_id long, text string")
    return secretscan.secret_report(docs).filter("n_random > 0").count() / tokens


def test_random_tokens_of_hex_and_base32_are_found(spark):
    for alphabet in ("0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"):
        for n in (24, 32, 64, 256):
            assert secret_recall(spark, alphabet, n) >= (0.9 if n > 24 else 0.75), (alphabet, n)
    plain = ["THEQUICKBROWNFOXJUMPSOVERTHELAZYDOG2", "INTERNATIONALORGANISATIONS2024REPORT", "FFFFFFFFFFFFFFFF0000000000000000", "20240131123045202401311230450A", "DEADBEEFDEADBEEFDEADBEEFDEADBEEF00"]
    docs = spark.createDataFrame(list(enumerate(plain)), "doc_id long, text string")
    assert secretscan.secret_report(docs).filter("n_random > 0").count() == 0


def test_longer_tokens_in_one_case_are_found_more_often(spark):
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    for alphabet in (lower + digits, lower.upper() + digits, lower + "234567"):
        short, long = (secret_recall(spark, alphabet, n) for n in (24, 64))
        assert long >= 0.9 and long >= short - 0.1, (alphabet, short, long)


def test_hamming_search(spark):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    codes = []
    for i in range(400):
        c = int(centres[i % 5])
        for b in rng.integers(0, 64, rng.integers(0, 12)):
            c ^= 1 << int(b)
        codes.append(c if c < 1 << 63 else c - (1 << 64))
    codes[50:120] = [codes[50]] * 70  # one very common code
    df = spark.createDataFrame(list(enumerate(codes)), "id long, code long")
    got = {}
    for r in hamming.hamming_top_k(df, df.filter("id % 20 = 0"), 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["id"]))
    for q in range(0, 400, 20):
        want = sorted((bin((codes[q] ^ c) & ((1 << 64) - 1)).count("1"), i) for i, c in enumerate(codes) if i != q)[:10]
        assert [x[1:] for x in sorted(got[q])] == want


@pytest.mark.parametrize("n", [1, 3, 12])
def test_hamming_search_of_few_and_far_codes(spark, n):
    rng = np.random.default_rng(n)
    codes = [int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, n)]
    df = spark.createDataFrame(list(enumerate(codes)), "id long, code long")
    got = sorted(map(tuple, hamming.hamming_top_k(df, df, 10).collect()))
    want = []
    for q in range(n):
        near = sorted((bin((codes[q] ^ c) & ((1 << 64) - 1)).count("1"), i) for i, c in enumerate(codes) if i != q)[:10]
        want += [(q, i, d, r + 1) for r, (d, i) in enumerate(near)]
    assert got == sorted(want)


def test_wand_finds_all_above_the_threshold():
    rng = random.Random(9)
    vocabulary = [f"t{i}" for i in range(60)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(3, 30))) for _ in range(120)]
    words = decontam.text_words(texts)
    df = np.unique(np.concatenate([np.unique(w) for w in words]), return_counts=True)
    index = decontam.ItemIndex(list(range(120)), words, *df, 120, sum(map(len, words)) / 120)
    for _ in range(150):
        terms = sorted(rng.sample(range(len(index.terms)), rng.randint(1, 25)))
        threshold = rng.choice([0.05, 0.2, 0.5])
        scores = {}
        for t in terms:
            for d, s in zip(*index.lists(t)[:2]):
                scores[d] = scores.get(d, 0.0) + s
        assert {d for d, s in scores.items() if s >= threshold + 1e-9} <= {d for d, _ in index.wand(terms, threshold)} <= {d for d, s in scores.items() if s >= threshold - 1e-9}


def test_contamination(spark):
    rng = random.Random(21)
    vocabulary = [f"word{i}" for i in range(300)] + ["the", "of", "and"] * 40
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([6, 15, 40, 90, 200])))) for i in range(30)]
    docs, planted = [], set()
    for d in range(60):
        words = rng.choices(vocabulary, k=rng.randint(0, 400))
        if d % 3 == 0:
            i = rng.randrange(30)
            at = rng.randint(0, len(words))
            words[at:at] = items[i][1].upper().replace(" ", ", ").split(" ") if d % 2 else items[i][1].split()
            planted.add((d, i))
        docs.append((d, " ".join(words)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(table, bench).collect()}
    assert got == planted
    kept = {r["doc_id"] for r in decontam.decontaminate(table, bench).collect()}
    assert kept == set(range(60)) - {d for d, _ in planted}
    split = list(decontam.item_indexes(bench, most=500))
    assert len(split) > 3 and sum(len(x.ids) for x in split) == 30


def test_contamination_in_other_scripts_and_cases(spark):
    items = ["ΟΔΟΣ ΤΩΝ ΦΙΛΩΝ ΠΡΟΣ ΤΟΝ ΚΟΣΜΟ", "İstanbul Boğazı üzerinde uzun bir köprü", "Er sagte: \u201eDas ist gut\u201c und ging nach Hause.", "他在大学里学习了四年的物理学", "l\u2019été dernier nous étions à la mer"]
    docs = [
        *items,
        "x " + "οδος των φιλων προς τον κοσμο" + " y",
        'a b. er sagte: "das ist gut" und ging nach hause - dann',
        "昨天他说他在大学里学习了四年的物理学然后工作",
        "L'ÉTÉ DERNIER NOUS ÉTIONS À LA MER\u00a0!",
        "他在大学里吃饭",
    ]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(table, bench).collect()}
    assert got == {(i, i) for i in range(5)} | {(5, 0), (6, 2), (7, 3), (8, 4)}


def bm25_contamination(docs, items):
    """(text, item) of all pairs whose best window reaches the threshold and whose overlaps hold, without an index."""
    words = [re.findall(r"\w+", t.lower()) for t in items]
    n, mean = len(words), sum(map(len, words)) / len(words)
    df = {}
    for w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = set()
    for i, w in enumerate(words):
        impact = {t: math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / mean)) for t in set(w)}
        norm = sum(impact.values()) * min(1.0, 48 / len(w))
        for d, text in enumerate(docs):
            h = re.findall(r"\w+", text.lower())
            starts = range(0, max(1, -(-(len(h) - 64) // 32) + 1) * 32, 32)
            score = max(sum(impact.get(t, 0.0) for t in set(h[a : a + 64])) / norm for a in starts)
            r = min(4, len(w))
            present = {tuple(h[a : a + r]) for a in range(len(h) - r + 1)}
            covered = [any(tuple(w[a : a + r]) in present for a in range(max(0, k - r + 1), min(k, len(w) - r) + 1)) for k in range(len(w))]
            half = (len(w) + 1) // 2
            answer = covered[half:] or covered[:1]
            if score >= decontam.THRESHOLD and sum(covered[:half]) / half >= 0.5 and sum(answer) / len(answer) >= 0.5:
                out.add((d, i))
    return out


def test_contamination_against_brute_force(spark):
    rng = random.Random(33)
    vocabulary = [f"w{i}" for i in range(80)]
    items = [" ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 8, 20, 70, 150]))) for _ in range(40)]
    docs = []
    for _ in range(80):
        h = rng.choices(vocabulary, k=rng.choice([1, 5, 40, 65, 200]))
        for _ in range(rng.randint(0, 3)):
            w = rng.choice(items).split()
            w = [t if rng.random() < rng.choice([1, 0.95, 0.7]) else "zz" for t in w]
            at = rng.randint(0, len(h))
            h[at:at] = w[rng.choice([0, 0, len(w) // 3]) :]
        docs.append(" ".join(h))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(table, bench).collect()}
    assert got == bm25_contamination(docs, items) and len(got) > 60


def test_mixture_against_exact_fractions(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" * 1 for _ in range(rng.choice([0, 1, 5, 60])))) for i in range(300)]
    table = spark.createDataFrame([(i, t, rng.choice(["a", "b", "c", "c", "c", None, "é"])) for i, t in rows], "doc_id long, text string, source string")
    got = mixture(table).collect()
    size = {}
    for r in got:
        size[r["source"]] = size.get(r["source"], 0) + r["size"]
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction([5, 2, 1][i % 3]) for i, s in enumerate(order)}
    left, target, free = Fraction(3, 2) * sum(size.values()), {}, set(order)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 2 * size[s]}
        if not full:
            target.update(share)
            break
        for s in full:
            target[s] = Fraction(2 * size[s])
            left -= target[s]
        free -= full
    for s in order:
        mine = [r for r in got if r["source"] == s]
        assert mine[0]["target"] == pytest.approx(float(target[s])) and mine[0]["source_size"] == size[s]
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= 60
        assert all(r["taken"] <= 2 * r["size"] for r in mine)
    again = {(r["doc_id"], r["taken"]) for r in mixture(table).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}


def test_nested_url_rules(spark):
    rng = random.Random(3)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "com", "b.org", "org"]
    paths = ["", "/", "/a", "/a/", "/a/b", "/b", "/ä", "/ab"]
    rules = [(h, p, rng.choice(["allow", "block"])) for h in hosts for p in paths if rng.random() < 0.5]
    urls = [(i, f"http://{rng.choice(['', 'www.'])}{rng.choice(hosts).upper()}{rng.choice(paths)}{rng.choice(['', 'c', '/b/c', '?q', '#f'])}") for i in range(300)]
    df = spark.createDataFrame(urls, "page_id long, url string")
    got = {r["page_id"]: r for r in urlrules.url_verdicts(df, spark.createDataFrame(rules, "host string, path string, verdict string"), "allow", swept=7).collect()}
    for i, u in urls:
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits) if fits else None
        assert (got[i]["rule"], got[i]["verdict"]) == ((best[2], best[3]) if best else (None, "allow")), u


def test_a_host_with_many_rules(spark):
    import time

    rules = urlrules.rules_frame(spark, [("a.com", "/" + "/".join(str(x) for x in (i % 40, i)), "block" if i % 2 else "allow") for i in range(4000)] + [("a.com", "/it's\\\\", "block")])
    pages = spark.createDataFrame([(i, f"http://a.com/{i % 40}/{i}/x") for i in range(4100)] + [(-1, "http://a.com/it's\\\\x")], "page_id long, url string")
    began = time.time()
    got = {r["page_id"]: r for r in urlrules.url_verdicts(pages, rules).collect()}
    assert time.time() - began < 30
    for i in range(4000):
        prefixes = [j for j in {int(str(i)[:n]) for n in range(1, 5)} if j % 40 == i % 40 and j < 4000]
        assert got[i]["rule"] == f"a.com/{i % 40}/{max(prefixes)}"
    assert got[-1]["verdict"] == "block"


def test_main_text():
    body = "A sentence long enough to count as text of the article. " * 3
    page = f"<html><head><title>t</title><style>p{{}}</style><script>var x='</p>'</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class='ad'>Buy now {body}</div><article><h1>Head &amp; more</h1><p>{body}<p>Short.<br>Tail</p></article><div id='comments'><p>{body}</p></div><footer>&copy; x</footer></body></html>"
    text = re.sub(r"\s+", " ", body).strip()
    assert htmlmain.main_text(page) == f"Head & more\n{text}\nShort.\nTail"
    plain = f"<div><a href=1>one</a> <a href=2>two</a></div><p>{body}</p><p>ok</p><p>{body}</p><div class=sidebar>{body}</div>"
    assert htmlmain.main_text(plain) == f"{text}\nok\n{text}"
    assert htmlmain.main_text(None) == "" and htmlmain.main_text("<p></p>") == "" and htmlmain.main_text("just words") == "just words"
    assert htmlmain.main_text("<article><p>&eacute;&#x41;</p></article>") == unescape("&eacute;A")


def licence_by_windows(text, templates, threshold):
    """(licence, dice, start, words, licences), from every window that begins and ends with a bigram of the template."""
    normal = lambda t: re.sub(r"[\W_]+", " ", t.lower()).split()
    w = normal(text)
    b = list(zip(w, w[1:]))
    matches = []
    for number, (name, body) in enumerate(templates):
        t = normal(body)
        want, pairs = set(zip(t, t[1:])), len(t) - 1
        found = []
        for i in [i for i, x in enumerate(b) if x in want]:
            end = max(j for j in range(i, min(i + pairs, len(b))) if b[j] in want)
            window = set(b[i : end + 1])
            dice = 2 * len(window & want) / (len(window) + len(want))
            if dice >= threshold:
                found.append((len(window & want), dice, -number, -i, end - i + 2, name))
        matches += [max(found)] if found else []
    best = max(matches, default=None)
    return (best[5], round(best[1], 6), -best[3], best[4], len({m[5] for m in matches})) if best else (None, None, None, None, 0)


def test_licences_against_brute_force(spark):
    rng = random.Random(17)
    bodies = [t for _, t in licenses.TEMPLATES]
    texts = [None, "", "license", "Licensed under CC BY-SA 4.0. Released under the MIT License."]
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 3)):
            body = rng.choice(bodies).split(" ")
            for _ in range(rng.choice([0, 0, 1, len(body) // 12, len(body) // 4])):
                at = rng.randrange(len(body))
                body[at : at + 1] = rng.choice([[], ["other"], [body[at], "more", "words"]])
            width = rng.choice([3, 8, 1000])
            lines = [" ".join(body[i : i + width]) for i in range(0, len(body), width)]
            parts += ["some text before it", rng.choice(["\n", "\n# ", "\n * ", "\n// "]).join(lines), "and after"]
        texts.append(rng.choice(["\n", " ", "; "]).join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r[c] for c in ("license", "dice", "start", "n_words", "n_licenses")) for r in licenses.license_report(docs).collect()}
    assert got == {i: licence_by_windows(t or "", licenses.TEMPLATES, 0.8) for i, t in enumerate(texts)}
    assert sum(g[0] is not None for g in got.values()) > 80
    assert licenses.scan_licenses(docs, templates=[]).filter("license is not null").count() == 0
    assert licenses.scan_licenses(docs, templates=[("x", "word")]).filter("license is not null").count() == 0


def test_a_long_text_full_of_licences(spark):
    import time

    text = "\n".join([licenses.TEMPLATES[0][1], "words between them " * 20] * 300)
    began = time.time()
    row = licenses.license_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["license"], row["dice"], row["start"]) == ("MIT", 1.0, 0) and time.time() - began < 40


def test_plain_words():
    raw, offsets = text_buffers(pa.array(["ab_1, é-x", ""], pa.string()))
    assert len(Words(raw, offsets, PLAIN_WORDS).hashes) == 3
