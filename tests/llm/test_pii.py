"""Personal data spans against a plain scan with Python's re; disclosure on a planted corpus."""
import hashlib
import random
import re

from tessera.llm import pii as P
from tessera.llm import spans as SP

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
PIECES = ["a", "b.c", "@", "x@y.z", ".", "_", "-", "1", "25", "255", "256", ".1", "4111111111111111", "4111 1111 1111 1111", "+1", " ", "  ", "(555)",
          "é", "😀", "\n", "0", "00", "%", "word", "+", "5500-0000-0000-0004", "1.2.3.4", "5.6.7.8", ".co"]


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def good(kind, v):
    digits = re.sub("[^0-9]", "", v)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in v.split(".")),
            "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def brute(text):
    text = text or ""
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text) if good(k, m[0]))


def test_against_plain_scan(spark):
    r = random.Random(9)
    rows = [(i, "".join(r.choices(PIECES, k=r.randint(0, 40)))) for i in range(600)]
    rows += [(1000, None), (1001, ""), (1002, "x@y.zz, +1 (555) 123-4567 " * 500), (1002, "x@y.zz, +1 (555) 123-4567 " * 500), (None, "a@b.c_d@e.f"),
             (1003, "a" * 150000), (1004, "1" * 150000), (1005, "1 2-" * 30000), (1006, "a." * 50000 + "@b"), (1007, "1." * 5000)]
    # The plain patterns take quadratic time on these long runs; none of them holds a match.
    empty = {1003, 1004, 1005, 1006}
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS private", "2 AS _key")
    out = P.find_private(df)
    got = out.select("doc_id", "text", "_key", SP.joined(P.F.col("base_private")).alias("b"), SP.joined(P.F.col("private")).alias("p")).collect()
    assert len(got) == len(rows)
    for o in got:
        assert o["b"] == ("" if o["doc_id"] in empty else brute(o["text"])), (o["text"] or "")[:300]
        assert o["p"].startswith(o["b"])
    assert P.find_private(df.limit(0)).count() == 0


def test_disclosing_terms(spark):
    rows = [(i, f"reach Ansprechmail user{i}@mail.example here\nplain line of words {i}") for i in range(30)]
    rows += [(100 + i, f"nothing here to see\nwords words line plain {i}") for i in range(200)]
    out = P.find_private(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in P.sanitise(out).collect()}
    assert "Ansprechmail" not in got[3]["sanitised"] and "<email>" in got[3]["sanitised"]
    assert "remove_email" in {s["kind"] for s in got[3]["private"]}
    assert "here" in got[3]["sanitised"] and got[105]["sanitised"] == rows[35][1]


def test_words_that_disclose_one_value(spark):
    rows = [(i, f"reach Zephyrine zeph@mail.example here\nplain line {i}" + "\nthanks to Zephyrine" * (i == 7)) for i in range(30)]
    rows += [(100 + i, f"nothing here to reach\nwords {i} line plain") for i in range(200)] + [(400, "Zephyrine"), (401, None), (402, "reach a@b.c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS Private", "1 AS _base", "2 AS c0")
    got = [tuple(r) for r in P.disclosing_words(df).select("doc_id", "start", "end", "kind", "term").collect()]
    want = [(i, 6, 15, "remove_email", "zephyrine") for i in range(30)]
    at = rows[7][1].index("Zephyrine", 20)
    want.append((7, at, at + 9, "remove_email", "zephyrine"))
    assert sorted(got) == sorted(want)
    # The operator itself marks the same words, on any line of the document.
    found = P.find_private(df)
    assert found.columns == ["doc_id", "text", "_base", "c0", "base_private", "private"]
    same = [(r["doc_id"], s["start"], s["end"], s["kind"], s["value"]) for r in found.collect() for s in r["private"] if s["order"] == len(P.KINDS)]
    assert sorted(same) == sorted(want)
    clean = {r["doc_id"]: r["sanitised"] for r in P.sanitise(found).collect()}
    assert clean[7] == "reach  <email> here\nplain line 7\nthanks to " and clean[400] == "Zephyrine" and clean[401] == "" and clean[402] == "reach <email>"
    assert P.disclosing_words(df.limit(0)).count() == 0


def test_query_on_table(spark, sf_small):
    from tessera.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    for r in QUERIES["op5_private"](spark, sf_small).collect():
        want = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PLAIN] == [want.count(k + ":") for k in PLAIN]
