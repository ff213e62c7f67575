"""Steps that a larger table must not widen: rows of pairs' tokens, files parsed whole, tokens split anew."""
import math
import random

from pyspark.sql import functions as F

from tessera.operators import features as FT
from tessera.operators import pairs as P
from tessera.plans import q_sinks, q_stems


def _brute(pairs, one, two):
    out = {}
    for a, b in pairs:
        dot = sum(n * two.get((b, t), 0) for (x, t), n in one.items() if x == a)
        na, nb = [sum(n * n for (x, _), n in side.items() if x == w) for side, w in ((one, a), (two, b))]
        out[a, b] = dot / math.sqrt(na * nb) if dot else 0.0
    return out


def test_cosine_of_two_sides_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(FT, "BLOCK", 7)
    rng = random.Random(5)
    bag = lambda: {(f"t{i}", f"k{rng.randrange(40)}"): rng.randrange(1, 9) for i in range(9) for _ in range(12)}
    one, two = bag(), bag()
    pairs = [(f"t{rng.randrange(11)}", f"t{rng.randrange(11)}") for _ in range(60)]
    frame = lambda b: spark.createDataFrame([(*k, n) for k, n in b.items()], "term string, tok string, n long")
    p, b1, b2 = spark.createDataFrame(pairs, "w1 string, w2 string"), frame(one), frame(two)
    for other, want in ((None, _brute(pairs, one, one)), (b2, _brute(pairs, one, two))):
        got = FT.bag_cosine(p, b1, "c", other).collect()
        assert len(got) == 60 and all(math.isclose(r["c"], want[r["w1"], r["w2"]], abs_tol=1e-12) for r in got)


def test_pair_tokens_are_no_rows_of_a_shuffle(spark):
    pairs = spark.createDataFrame([("a", "b")], "w1 string, w2 string")
    plan = FT.bag_cosine(pairs, spark.createDataFrame([("a", "x", 1)], "term string, tok string, n long"))._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "(n1#" not in plan


def test_files_follow_the_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(q_sinks, "FILE_BYTES", 100)
    made = []
    read = q_sinks.K.read_directory
    monkeypatch.setattr(q_sinks.K, "read_directory", lambda s, path: made.append(read(s, path)) or made[0])
    spark.createDataFrame([(i, f"line {i} " + "a" * 40) for i in range(100)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert q_sinks.sink_directory(spark, str(tmp_path)).agg(F.sum("n")).first()[0] == 100
    assert made[0].count() > 16


def test_one_shuffle_by_document(spark, sf_small):
    plan = q_stems.document_stem_counts(spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(doc_id#") == 1


def test_phrases_split_tokens_once(spark):
    rows = spark.createDataFrame([("a b c",), ("b c",), ("c",)], "term string")
    cands = P.candidate_pairs(rows, rows)
    assert sorted(map(tuple, cands.collect())) == [("b c", "a b c"), ("c", "a b c"), ("c", "b c")]
    assert cands._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 3
