"""Held-out accuracy, what a score may depend on, and rows at the edges."""
import zlib

import numpy as np

from tessera.llm import quality as Q
from tessera.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in QUERIES["op3_quality"](spark, d).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for i, r in got.items())
    test = [(got[r["doc_id"]]["score"], r["quality"]) for r in spark.read.parquet(f"{d}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    assert np.mean([(s >= 0.3) == q for s, q in test]) > 0.98
    good, bad = [s for s, q in test if q], [s for s, q in test if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.99


def test_held_out_labels_are_not_read(spark, sf_small):
    docs, labels = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("documents", "labels"))
    a = Q.fit(docs, labels)
    b = Q.fit(docs, labels.withColumn("quality", Q.F.when(Q.held_out(Q.F.col("doc_id")), 1 - Q.F.col("quality")).otherwise(Q.F.col("quality"))))
    assert np.array_equal(a.w, b.w) and a.at == b.at


def test_pairs_learn_an_order():
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 5))
    y = (x @ [2, -1, 0, 0, 0] + r.normal(scale=0.3, size=400) > -1).astype(int)
    m = Q.fit_pairs(x, y)
    assert np.mean((m.score(x) >= Q.CUT) == y) > 0.9
    for labels in (np.ones(400, int), np.zeros(400, int)):
        assert (Q.fit_pairs(x, labels).score(x) == 0.5).all()


def test_edge_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "fine words here", "a"), (3, "fine words here", "a"), (None, "x " * 100000, None), (5, "\x00   é", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(3, 1), (3, 1), (1, 0), (None, 1), (2, None), (5, 7)], "doc_id long, quality int")
    got = Q.score_documents(docs, Q.fit(docs, labels)).collect()
    assert len(got) == len(rows) and got[0]["score"] == got[1]["score"] and got[2]["score"] == got[3]["score"]
    nothing = Q.fit(docs.limit(0), labels.limit(0))
    assert Q.score_documents(docs.limit(0), nothing).count() == 0
    assert {r["score"] for r in Q.score_documents(docs, nothing).collect()} == {0.5}
