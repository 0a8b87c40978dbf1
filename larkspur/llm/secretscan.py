r"""Secrets in texts: fixed patterns, and a randomness test battery over other tokens.

Everything is a Spark expression over one row; nothing is shuffled.

Positions: ``regexp_extract_all`` with ``\G(.*?)(pattern)`` gives each match with
the gap before it, so running sums of code points give the spans of leftmost
matches that don't overlap, in one pass per pattern.  All lists of a row (matches,
tokens, tests) are gone through a fixed number of times, so the time is linear in
the text but for sorting.

Battery: candidates are runs of 24 or more letters, digits and ``+/_-`` that
don't overlap a pattern's span.  The encoding is inferred from the characters in
use (hex, base 32, letters of one case and digits, letters and digits, base 64
and its URL form; of digits alone
or letters of one case no test can tell a key, so these are left out).  Over the
positions of the characters in the encoding's alphabet three tests ask whether
the token is random:

* chi-squared uniformity over the alphabet, against its mean and variance;
* runs above and below the middle of the alphabet;
* serial correlation of neighbours.

A token is random if none of them rejects it at ``RANDOM_LEVEL``.  What it must
also be is unlike text.  Of encodings in one case, an alternative is given per
character: words with a few digits, or numbers with a few letters.  The chance
that either makes a token as much likelier to be random is at most the inverse of
the likelihood ratio, which is thus a p-value for each; the larger one counts.  Of
encodings in both cases, the chi-squared statistic grows under text with the
length by the unevenness of letters, so its left tail is a p-value that short
tokens can't make small.  These p-values go through the Benjamini-Hochberg
procedure per document, with the level shared in proportion to the tokens'
lengths, which controls the false discoveries of the document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: The same matches, without those that are too short: each is the rest of its run.
LONG_ACCESS, LONG_HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16

TOKEN = r"[A-Za-z0-9+/_-]{24,}={0,2}"
LEAST_TOKEN, TOKEN_ORDER = 24, 3
#: Items that a fold takes before what it has emitted is put aside.
FOLD_PIECE = 256
RANDOM_LEVEL_Z = 3.0
DISCOVERY_LEVEL = 0.001
_LOWER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: name, pattern of the whole token, alphabet; the first that fits is taken.
ENCODINGS = [
    ("hex", r"(?:[0-9]*[a-f][0-9a-f]*[0-9][0-9a-f]*|[0-9a-f]*[0-9][0-9a-f]*[a-f][0-9a-f]*)", _DIGITS + "abcdef"),
    ("hex_upper", r"(?=[0-9A-F]*[A-F])(?=[0-9A-F]*[0-9])[0-9A-F]+", _DIGITS + "ABCDEF"),
    ("base32", r"(?=[A-Z2-7]*[2-7])(?=[A-Z2-7]*[A-Z])[A-Z2-7]+={0,2}", _LOWER.upper() + "234567"),
    ("base32_lower", r"(?=[a-z2-7]*[2-7])(?=[a-z2-7]*[a-z])[a-z2-7]+={0,2}", _LOWER + "234567"),
    ("base36", r"(?=[a-z]*[0-9])(?=[0-9]*[a-z])[a-z0-9]+={0,2}", _DIGITS + _LOWER),
    ("base36_upper", r"(?=[A-Z]*[0-9])(?=[0-9]*[A-Z])[A-Z0-9]+={0,2}", _DIGITS + _LOWER.upper()),
    ("alphanumeric", r"(?=[a-zA-Z]*[0-9])(?=.*[a-zA-Z])[a-zA-Z0-9]+={0,2}", _LOWER.upper() + _LOWER + _DIGITS),
    ("letters", r"(?=.*[a-z])(?=.*[A-Z].*[A-Z].*[A-Z])[a-zA-Z]+={0,2}", _LOWER.upper() + _LOWER),
    ("base64", r"(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])[a-zA-Z0-9+/]+={0,2}", _LOWER.upper() + _LOWER + _DIGITS + "+/"),
    ("base64url", r"(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])[a-zA-Z0-9_-]+={0,2}", _LOWER.upper() + _LOWER + _DIGITS + "_-"),
]
#: Sum of squared letter frequencies of text in European languages, about the same in all of them.
TEXT_COINCIDENCE = 0.067
#: Encodings in one case, which are held against words and numbers character by character.
ONE_CASE = {"hex", "hex_upper", "base32", "base32_lower", "base36", "base36_upper"}
#: Per mille of letters a to z in text of European languages.
LETTERS = (80, 14, 33, 43, 140, 14, 17, 25, 75, 4, 6, 45, 26, 77, 65, 24, 5, 66, 67, 71, 34, 11, 11, 3, 9, 4)
#: Share of digits among words, and of letters among numbers.
WORD_DIGITS, NUMBER_LETTERS = 0.05, 0.1

_SPAN = "struct<kind:string,order:int,start:long,end:long,hit:string>"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once: Spark shares nothing between uses inside lambda functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fold(items: Column, state: Column, step, kind: str) -> Column:
    """The array (of ``kind``) that ``step`` emits over ``items`` in order.

    ``step`` takes (state, item) and gives (next state, array to emit).  Items go
    in pieces of ``FOLD_PIECE``, as what has been emitted is copied with every
    item; the work is thus linear in the items.
    """

    def inner(acc: Column, x: Column) -> Column:
        after, out = step(acc["state"], x)
        return F.struct(after.alias("state"), F.when(F.size(out) > 0, F.concat(acc["out"], out)).otherwise(acc["out"]).alias("out"))

    def piece(acc: Column, part: Column) -> Column:
        begin = F.struct(acc["state"].alias("state"), F.array().cast(kind).alias("out"))
        return _let(F.aggregate(part, begin, inner), lambda done: F.struct(done["state"].alias("state"), F.concat(acc["out"], F.array(done["out"])).alias("out")))

    def whole(a: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / FOLD_PIECE).cast("int")), lambda i: F.slice(a, i * FOLD_PIECE + 1, FOLD_PIECE))
        begin = F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.when(F.size(a) > 0, F.flatten(F.aggregate(parts, begin, piece, lambda acc: acc["out"]))).otherwise(F.array().cast(kind))

    return _let(items, whole)


def _spans(text: Column, kind: str, order: int, pattern: str, value: int, least: int, test: Column) -> Column:
    """Spans of the pattern's leftmost matches whose group ``value`` (0: the match) has ``least`` characters."""
    whole = F.lit(rf"(?s)\G(.*?)({pattern})")
    gaps = F.regexp_extract_all(text, whole, F.lit(1))
    hits = F.regexp_extract_all(text, whole, F.lit(2))
    values = F.regexp_extract_all(text, whole, F.lit(2 + value)) if value else hits
    pairs = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), F.transform(values, F.length).alias("size"))
    empty = F.array().cast(f"array<{_SPAN}>")

    def step(at: Column, p: Column) -> tuple[Column, Column]:
        start = at + F.length(p["gap"])
        end = start + F.length(p["hit"])
        span = F.struct(F.lit(kind).alias("kind"), F.lit(order).alias("order"), start.alias("start"), end.alias("end"), p["hit"].alias("hit"))
        return end, F.when(p["size"] >= least, F.array(span)).otherwise(empty)

    return F.when(test, _fold(pairs, F.lit(0).cast("long"), step, f"array<{_SPAN}>")).otherwise(empty)


def _tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution, by a logistic approximation."""
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def _unlike_text(body: Column, k: Column, n: Column) -> Column:
    """The p-value of a token in one case over an alphabet of ``k``."""

    def count(chars: str) -> Column:
        return n - F.length(F.translate(body, chars, ""))

    digits = count(_DIGITS)
    letters = F.array(*[count(c + c.upper()) * math.log((1 - WORD_DIGITS) * f / sum(LETTERS)) for c, f in zip(_LOWER, LETTERS)])
    words = F.aggregate(letters, digits * math.log(WORD_DIGITS / 10), lambda a, x: a + x)
    numbers = digits * math.log((1 - NUMBER_LETTERS) / 10) + (n - digits) * math.log(NUMBER_LETTERS / 26)
    return F.least(F.lit(1.0), F.exp(n * F.log(k) + F.greatest(words, numbers)))


def _battery(hit: Column) -> Column:
    """struct(random, p, n): whether no test rejects the token, its p-value under text, and its length."""
    alphabet = F.lit(None).cast("string")
    for _, pattern, chars in reversed(ENCODINGS):
        alphabet = F.when(F.regexp_like(hit, F.lit(f"^{pattern}$")), F.lit(chars)).otherwise(alphabet)
    none = F.struct(F.lit(False).alias("random"), F.lit(1.0).alias("p"), F.length(hit).cast("double").alias("n"))

    def start(e: Column) -> Column:
        chars = F.split(e["body"], "")
        x = F.transform(chars, lambda c: (F.call_function("locate", c, e["alphabet"]) - 1).cast("double"))
        k = F.length(e["alphabet"]).cast("double")
        counts = F.transform(F.array_distinct(chars), lambda c: F.length(e["body"]) - F.length(F.replace(e["body"], c, F.lit(""))))
        squares = F.aggregate(counts, F.lit(0.0), lambda a, b: a + (b * b).cast("double"))
        return F.struct(e["body"].alias("body"), e["alphabet"].alias("alphabet"), F.length(e["body"]).cast("double").alias("n"), k.alias("k"), x.alias("x"), squares.alias("squares"))

    def sums(e: Column) -> Column:
        """In one pass over the positions: those above the middle, runs, and neighbours' products."""
        mean = (e["k"] - 1) / 2
        first = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("high"), F.lit(0.0).alias("runs"), F.lit(0.0).alias("together"))

        def step(a: Column, v: Column) -> Column:
            high = v * 2 >= e["k"]
            turn = F.coalesce((a["last"] * 2 >= e["k"]) != high, F.lit(True))
            product = F.coalesce((a["last"] - mean) * (v - mean), F.lit(0.0))
            return F.struct(v.alias("last"), (a["high"] + F.when(high, 1.0).otherwise(0.0)).alias("high"), (a["runs"] + F.when(turn, 1.0).otherwise(0.0)).alias("runs"), (a["together"] + product).alias("together"))

        return F.struct(e.alias("e"), F.aggregate(e["x"], first, step).alias("s"))

    def scores(t: Column) -> Column:
        n, k, s = t["e"]["n"], t["e"]["k"], t["s"]
        share = 2 * s["high"] * (n - s["high"]) / n
        return F.struct(t["e"].alias("e"), s.alias("s"), (t["e"]["squares"] * k / n - n).alias("chi"), share.alias("share"), (share * (share - 1) / F.greatest(n - 1, F.lit(1.0))).alias("variance"))

    def verdict(t: Column) -> Column:
        n, k, s = t["e"]["n"], t["e"]["k"], t["s"]
        df = k - 1
        z_chi = (t["chi"] - df) / F.sqrt(2 * df * (n - 1) / n)
        z_runs = F.when(t["variance"] > 0, (s["runs"] - t["share"] - 1) / F.sqrt(t["variance"])).otherwise(F.lit(99.0))
        z_serial = s["together"] / ((k * k - 1) / 12) / F.sqrt(n - 1)
        random = (F.abs(z_chi) < RANDOM_LEVEL_Z) & (F.abs(z_runs) < RANDOM_LEVEL_Z) & (F.abs(z_serial) < RANDOM_LEVEL_Z)
        uneven = n * (TEXT_COINCIDENCE * k - 1)
        one_case = t["e"]["alphabet"].isin([chars for name, _, chars in ENCODINGS if name in ONE_CASE])
        p = F.when(one_case, _unlike_text(t["e"]["body"], k, n)).otherwise(_let(uneven, lambda u: _tail((df + u - t["chi"]) / F.sqrt(2 * df + 4 * u))))
        return F.struct(F.coalesce(random, F.lit(False)).alias("random"), F.coalesce(p, F.lit(1.0)).alias("p"), n.alias("n"))

    def judged(e: Column) -> Column:
        return F.when(e["alphabet"].isNull(), none).otherwise(_let(_let(_let(_let(e, start), sums), scores), verdict))

    return _let(F.struct(F.regexp_replace(hit, "=+$", "").alias("body"), alphabet.alias("alphabet")), judged)


def _free(base: Column, tokens: Column) -> Column:
    """Those of the (disjoint) tokens that no span of ``base`` overlaps, by a merge of both in order of their starts."""
    kind = f"array<{_SPAN}>"
    empty = F.array().cast(kind)
    state = "struct<reach:long,held:array<" + _SPAN + ">>"
    # A base span stands before a token of equal start; the end mark lets the last token go.
    mark = F.struct(F.lit("end").alias("kind"), F.lit(-1).alias("order"), F.lit((1 << 62)).cast("long").alias("start"), F.lit((1 << 62)).cast("long").alias("end"), F.lit("").alias("hit"))
    by_start = F.transform(F.concat(base, tokens, F.array(mark)), lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s.alias("s")))
    ordered = F.transform(F.array_sort(by_start), lambda k: k["s"])

    def step(acc: Column, s: Column) -> tuple[Column, Column]:
        is_token = s["order"] == TOKEN_ORDER
        reach = F.when(is_token, acc["reach"]).otherwise(F.greatest(acc["reach"], s["end"]))
        held = F.when(is_token & (acc["reach"] <= s["start"]), F.array(s)).otherwise(empty)
        # A token held is free once what starts next starts at or after its end.
        clear = F.filter(acc["held"], lambda t: t["end"] <= s["start"])
        return F.struct(reach.alias("reach"), held.alias("held")).cast(state), clear

    first = F.struct(F.lit(0).cast("long").alias("reach"), empty.alias("held")).cast(state)
    return F.when(F.size(tokens) > 0, _fold(ordered, first, step, kind)).otherwise(empty)


def _discoveries(tested: Column) -> Column:
    """Spans of kind random: tested tokens (span, test) that pass the battery under false-discovery control.

    Weighted Benjamini-Hochberg: p / weight is compared, weights are lengths over their mean.
    """

    def weigh(t: Column) -> Column:
        mean = F.aggregate(t, F.lit(0.0), lambda a, x: a + x["test"]["n"]) / F.size(t)
        return _let(mean, lambda m: F.transform(t, lambda x: F.struct((x["test"]["p"] * m / x["test"]["n"]).alias("p"), x["test"]["random"].alias("random"), x["span"].alias("span"))))

    def limit(w: Column) -> Column:
        passing = F.transform(F.array_sort(F.transform(w, lambda x: x["p"])), lambda p, i: F.struct(p.alias("p"), (i + 1).cast("double").alias("rank")))
        level = F.lit(DISCOVERY_LEVEL) / F.size(w)
        most = _let(level, lambda v: F.array_max(F.transform(passing, lambda x: F.when(x["p"] <= v * x["rank"], x["p"]).otherwise(-1.0))))
        return F.struct(w.alias("w"), most.alias("most"))

    def take(x: Column) -> Column:
        return F.transform(F.filter(x["w"], lambda t: t["random"] & (t["p"] <= x["most"])), lambda t: t["span"])

    empty = F.array().cast(f"array<{_SPAN}>")
    return _let(tested, lambda t: F.when(F.size(t) == 0, empty).otherwise(_let(_let(_let(t, weigh), limit), take)))


def _joined(spans: Column) -> Column:
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, the spans found by the patterns (base) and by the battery (extra), per row of ``docs``.

    Spans are structs (kind, order, start, end, hit) in code points, end
    exclusive.  A null text is an empty one.  Repeated rows are returned as often
    as they come; other columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    t = F.col("text")
    assign = _spans(t, "assign", 0, ASSIGN, 2, LEAST_ASSIGN, F.regexp_like(t, F.lit(r"(?i)(?:passw|secret|token|api_?key)")))
    access = _spans(t, "access", 1, LONG_ACCESS, 0, LEAST_ACCESS, F.contains(t, F.lit("AKIA")))
    hexes = _spans(t, "hex", 2, LONG_HEX, 0, LEAST_HEX, F.regexp_like(t, F.lit("[0-9a-f]{16}")))
    rows = rows.select("doc_id", "text", F.concat(assign, access, hexes).alias("base"))
    tokens = _spans(t, "random", TOKEN_ORDER, TOKEN, 0, LEAST_TOKEN, F.regexp_like(t, F.lit(TOKEN)))
    free = _let(F.struct(F.col("base").alias("base"), tokens.alias("tokens")), lambda x: _free(x["base"], x["tokens"]))
    tested = F.transform(free, lambda s: F.struct(s.alias("span"), _battery(s["hit"]).alias("test")))
    return rows.select("doc_id", "base", _discoveries(tested).alias("extra"))


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    found = find_secrets(docs)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "extra")).alias("spans"), F.size("extra").cast("long").alias("n_random"))


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def _fits_sql(pattern: str) -> str:
    """A condition on ``hit`` for a pattern of ENCODINGS, with a test of its own in place of each lookahead."""
    ahead, rest = [], pattern
    while rest.startswith("(?="):
        end = rest.index(")")
        ahead.append(rest[3:end])
        rest = rest[end + 1 :]
    return " AND ".join([f"regexp_full_match(hit, '{rest}')", *[f"regexp_matches(hit, '^{a}')" for a in ahead]])


def secrets_sql() -> str:
    """DuckDB SQL for ``secret_report`` of the table documents."""
    names = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key")
    assign = rf"""({names})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    found = " UNION ALL ".join(
        f"SELECT n, '{kind}' AS kind, {order} AS ord, {least} AS least, regexp_extract_all(text, '(?s)(.*?)({pattern})', 1) AS gaps, regexp_extract_all(text, '(?s)(.*?)({pattern})', 2) AS hits, regexp_extract_all(text, '(?s)(.*?)({pattern})', {value}) AS vals FROM docs"
        for kind, order, pattern, value, least in (("assign", 0, assign, 4, LEAST_ASSIGN), ("access", 1, ACCESS, 2, LEAST_ACCESS), ("hex", 2, HEX, 2, LEAST_HEX), ("random", TOKEN_ORDER, TOKEN, 2, LEAST_TOKEN))
    )
    alphabets = " ".join(f"WHEN {_fits_sql(p)} THEN '{chars}'" for _, p, chars in ENCODINGS)
    one_case = ", ".join(f"'{chars}'" for name, _, chars in ENCODINGS if name in ONE_CASE)
    logs = " ".join(f"WHEN '{c}' THEN {math.log((1 - WORD_DIGITS) * f / sum(LETTERS))!r}::DOUBLE" for c, f in zip(_LOWER, LETTERS))
    z, c, level = RANDOM_LEVEL_Z, TEXT_COINCIDENCE, DISCOVERY_LEVEL
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
lists AS ({found}),
steps AS (SELECT n, kind, ord, least, generate_subscripts(hits, 1) AS i, unnest(gaps) AS gap, unnest(hits) AS hit, unnest(vals) AS val FROM lists),
placed AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY n, ord ORDER BY i)::BIGINT AS upto FROM steps),
spans AS (SELECT n, kind, ord, upto - length(hit) AS start, upto, hit FROM placed WHERE length(val) >= least),
base AS (SELECT * FROM spans WHERE ord < 3),
free AS (SELECT row_number() OVER () AS id, * FROM spans t WHERE ord = 3 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.n = t.n AND b.start < t.upto AND t.start < b.upto)),
coded AS (SELECT *, regexp_replace(hit, '=+$', '') AS body, CASE {alphabets} END AS alphabet FROM free),
chars AS (SELECT id, length(body) AS size, length(alphabet) AS k, c, i, strpos(alphabet, c) - 1 AS x
  FROM (SELECT id, body, alphabet, unnest(string_split(body, '')) AS c, generate_subscripts(string_split(body, ''), 1) AS i FROM coded WHERE alphabet IS NOT NULL)),
near AS (SELECT *, lag(x) OVER (PARTITION BY id ORDER BY i) AS last FROM chars),
sums AS (SELECT id, any_value(size)::DOUBLE AS m, any_value(k)::DOUBLE AS k, count(*) FILTER (2 * x >= k)::DOUBLE AS high,
    count(*) FILTER (last IS NULL OR (2 * x >= k) <> (2 * last >= k))::DOUBLE AS runs, coalesce(sum((x - (k - 1) / 2.0::DOUBLE) * (last - (k - 1) / 2.0::DOUBLE)), 0.0::DOUBLE) AS together,
    count(*) FILTER (c BETWEEN '0' AND '9')::DOUBLE AS digits, sum(CASE lower(c) {logs} ELSE {math.log(WORD_DIGITS / 10)!r}::DOUBLE END) AS words FROM near GROUP BY id),
squares AS (SELECT id, sum(q * q)::DOUBLE AS squares FROM (SELECT id, c, count(*) AS q FROM chars GROUP BY ALL) GROUP BY id),
scores AS (SELECT *, squares * k / m - m AS chi, k - 1 AS df, 2 * high * (m - high) / m AS share, m * ({c}::DOUBLE * k - 1) AS uneven FROM sums JOIN squares USING (id)),
parts AS (SELECT *, share * (share - 1) / greatest(m - 1, 1) AS variance, (df + uneven - chi) / sqrt(2 * df + 4 * uneven) AS t FROM scores),
tests AS (SELECT id, abs((chi - df) / sqrt(2 * df * (m - 1) / m)) < {z} AND CASE WHEN variance > 0 THEN abs((runs - share - 1) / sqrt(variance)) < {z} ELSE false END
    AND abs(together / ((k * k - 1) / 12) / sqrt(m - 1)) < {z} AS random,
    m * ln(k) + greatest(words, digits * {math.log((1 - NUMBER_LETTERS) / 10)!r}::DOUBLE + (m - digits) * {math.log(NUMBER_LETTERS / 26)!r}::DOUBLE) AS ratio, t FROM parts),
tested AS (SELECT f.*, coalesce(t.random, false) AS random, CASE WHEN f.alphabet IS NULL THEN 1.0 WHEN f.alphabet IN ({one_case}) THEN exp(least(0, ratio)) ELSE 1 / (1 + exp(1.5976 * t + 0.07056 * t * t * t)) END AS p,
    CASE WHEN f.alphabet IS NULL THEN length(hit) ELSE length(body) END::DOUBLE AS size FROM coded f LEFT JOIN tests t USING (id)),
weighed AS (SELECT *, p * avg(size) OVER (PARTITION BY n) / size AS w, count(*) OVER (PARTITION BY n) AS tokens FROM tested),
levels AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY w) AS k FROM weighed),
limits AS (SELECT *, max(CASE WHEN w <= {level}::DOUBLE * k / tokens THEN w ELSE -1 END) OVER (PARTITION BY n) AS most FROM levels),
every AS (SELECT n, kind, ord, start, upto FROM base UNION ALL SELECT n, kind, ord, start, upto FROM limits WHERE random AND w <= most),
told AS (SELECT n, string_agg(kind || ':' || start || ':' || upto, ',' ORDER BY start, ord) AS spans, string_agg(kind || ':' || start || ':' || upto, ',' ORDER BY start, ord) FILTER (ord < 3) AS base,
    count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex, count(*) FILTER (ord = 3) AS n_random FROM every GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_random, 0)::BIGINT AS n_random
FROM docs LEFT JOIN told USING (n)
"""
