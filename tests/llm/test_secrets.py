"""Secret spans against a plain scan with Python's re."""
import hashlib
import random
import re

import pytest

from tessera.llm import secrets as S

ASSIGN = re.compile(r"""((?:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
PIECES = ["password", "PassWd", "secret", "tOken", "api_key", "apikey", "=", ":", " ", '"', "'", "abcdef12", "abc", "AKIA", "ABCDEFGH12345678",
          "0123456789abcdef", "deadbeefcafe", "é", "😀", "\n", ".", "x://u:p@h", "the", "İ", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 20]


def brute(text):
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_derived_queries():
    assert S.derive("[0-9a-f]{24,}") is True
    assert S.grams_of(S.derive("AKIA[A-Z0-9]{16,}")) == {"aki", "kia"}
    q = S.derive(S.RULES[0].pattern)
    assert q[0] == "or" and {"pas", "swo", "swd", "tok", "pik", "pi_", "i_k"} <= S.grams_of(q)
    assert S.derive("(abc)?x") is True
    assert S.derive("abcd|xyz")[0] == "or"


def test_against_plain_scan(spark):
    r = random.Random(5)
    rows = [(i, "".join(r.choices(PIECES, k=r.randint(0, 60)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "token=abcdefg " * 3000), (1002, "token=abcdefg " * 3000), (None, "secret:token:abcdefgh"),
             (1003, "a" * 200000), (1004, "token==" + "x" * 100000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' AS grams", "1 AS Secrets", "'own' AS _all", "'own' AS _text", "'own' AS c1")
    out = S.find_secrets(df)
    assert out.columns == ["doc_id", "text", "_all", "_text", "c1", "grams", "secrets", "base_secrets"] and out.filter("_all <> 'own' OR _text <> 'own' OR c1 <> 'own'").isEmpty()
    out = out.select("doc_id", "text", S.listed(S.F.col("base_secrets")).alias("b"), S.listed(S.F.col("secrets")).alias("a")).collect()
    assert len(out) == len(rows)
    for o in out:
        assert o["b"] == brute(o["text"]), o["text"][:200] if o["text"] else o
        assert set(filter(None, o["b"].split(","))) <= set(o["a"].split(","))
    assert S.find_secrets(df.limit(0)).count() == 0


def test_query_on_table(spark, sf_small):
    from tessera.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    for r in QUERIES["op1_secrets"](spark, sf_small).collect():
        want = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(want.count(k + ":") for k in ("assign", "access", "hex"))


@pytest.mark.parametrize("text,want", [("x token=abcdefg y", "x <assign> y"), ("", ""), (None, "")])
def test_redact(spark, text, want):
    df = S.redact(S.find_secrets(spark.createDataFrame([(text,)], "text string")))
    assert df.first()["redacted"] == want


KEY = "-----BEGIN RSA PRIVATE KEY-----\n" + ("Ab1+/" * 12 + "Cd2=\n") * 3 + "Ef3=="


@pytest.mark.parametrize("text,want", [
    ("a " + KEY + "\n-----END RSA PRIVATE KEY----- b", "a <private_key> b"), ("a " + KEY, "a <private_key>"), (KEY + "\n--- b", "<private_key>\n--- b"),
    (KEY + "\n" + KEY + "\n-----END RSA PRIVATE KEY-----", "<private_key>\n<private_key>"), ("-----BEGIN PRIVATE KEY----- in prose", "<private_key> in prose"),
    (KEY.replace("\n", "\\n") + "\\n-----END RSA PRIVATE KEY-----", "<private_key>"), (KEY.replace("-\n", "-\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES,00\n\n"), "<private_key>"),
    (KEY.replace("Ef3==", "Ab1+/\n" * 60000) + "-----END RSA PRIVATE KEY-----", "<private_key>"),
    ("see x://u:" + "p" * 300 + "@h", "see <url_login>h"), ("s3://" + "k" * 100 + ":pw@h", "<url_login>h"), ("git+SSH://u:pw@h", "<url_login>h"), ("x://u:" + "p" * 90, "x://u:" + "p" * 90),
    ("z" * 150000 + " ://", "z" * 150000 + " ://")])
def test_long_secrets(spark, text, want):
    df = spark.createDataFrame([(text,)], "text string")
    assert S.redact(S.find_secrets(df)).first()["redacted"] == want
    if len(text) < 10000:  # the SQL's patterns give the same
        import duckdb

        for r in S.RULES[3::4]:
            got = [x["value"] for x in df.select(S.verify(S.F.col("text"), r).alias("v")).first()["v"]]
            assert got == duckdb.execute("SELECT regexp_extract_all(?, ?)", [text, r.pattern]).fetchone()[0]
