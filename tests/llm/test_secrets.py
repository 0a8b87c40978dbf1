"""The secret scan against its SQL on texts full of tokens, and its time."""

import random
import time

import duckdb

from larkspur.llm import secretscan

LETTERS = "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = ["0123456789abcdef", "0123456789ABCDEF", LETTERS.upper() + "234567", LETTERS + "234567", LETTERS + "0123456789", LETTERS.upper() + "0123456789", LETTERS + LETTERS.upper() + "0123456789", LETTERS + LETTERS.upper(), LETTERS + LETTERS.upper() + "0123456789+/", LETTERS + LETTERS.upper() + "0123456789_-", "ab", "0123456789"]


def test_battery_and_false_discovery_control_against_sql(spark, tmp_path):
    rng = random.Random(12)
    texts = [None, "", "=" * 40, "token=" + "a" * 30 + "secret: 'q'"]
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(0, 12)):
            token = "".join(rng.choices(rng.choice(ALPHABETS), k=rng.choice([8, 23, 24, 31, 32, 48, 64, 200]))) + "=" * rng.choice([0, 0, 1, 2])
            parts += [rng.choice(["", "token=", "Password: ", "é ", "see/"]) + token, rng.choice([" ", "\n", ",", "😀", "a plain word "])]
        texts.append("".join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)) + [(5, texts[5])], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    cur = con.execute(secretscan.secrets_sql())
    names = [d[0] for d in cur.description]
    want = sorted(str(dict(zip(names, r))) for r in cur.fetchall())
    got = sorted(str({c: r[c] for c in names}) for r in secretscan.secret_report(docs).collect())
    assert got == want
    assert sum("random:" in g for g in got) > 40


def test_ten_thousand_tokens_in_one_text(spark):
    rng = random.Random(13)

    def took(n):
        text = " ".join("".join(rng.choices(ALPHABETS[6], k=32)) for _ in range(n)) + " " + " ".join("%032x" % rng.getrandbits(128) for _ in range(n))
        began = time.time()
        row = secretscan.secret_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
        assert row["n_hex"] == n and row["n_random"] > 0.9 * n
        return time.time() - began

    took(100)
    assert took(10_000) < 20
