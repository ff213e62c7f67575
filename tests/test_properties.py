"""Properties: ranks, folds, curves, symmetry, stems, negatives."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.stem import porter, stem_tokens
from tessera.operators import folds as O
from tessera.operators import metrics as M
from tessera.operators import pairs as P
from tessera.operators.rank import blocked_cumsum, global_rank, numeric_rank


def test_global_rank_equals_row_number(spark):
    df = spark.range(5000).withColumn("h", F.md5(F.col("id").cast("string")))
    r = global_rank(df, ["h"], F.substring("h", 1, 2), "r")
    ref = df.withColumn("r2", F.row_number().over(Window.orderBy("h")) - 1)
    assert r.join(ref, ["id", "h"]).filter(F.col("r") != F.col("r2")).count() == 0


def test_partitioned_rank_and_cumsum(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"), F.lit(1).alias("v"))
    r = global_rank(df, ["o"], F.floor(F.col("o") / 100), "r", partition_by=["k"])
    ref = df.withColumn("r2", F.row_number().over(Window.partitionBy("k").orderBy("o")) - 1)
    assert r.join(ref, ["k", "o"]).filter(F.col("r") != F.col("r2")).count() == 0
    c = blocked_cumsum(df, F.col("v"), "o", "c", ["k"], n=16)
    assert c.filter(F.col("c") != F.floor(F.col("o") / 3) + 1).count() == 0


def test_numeric_rank_sparse_orders(spark):
    df = spark.range(2000).select((F.col("id") * F.col("id") * 1000003).alias("o"))
    r = numeric_rank(df, "o", "r", n=32)
    ref = df.withColumn("r2", F.row_number().over(Window.orderBy("o")) - 1)
    assert r.join(ref, "o").filter(F.col("r") != F.col("r2")).count() == 0


def test_folds_disjoint_equal(spark):
    df = spark.range(1003)
    f = O.ten_folds(df, ["id"])
    sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert sorted(set(sizes)) == [100] and f.select("id").distinct().count() == 1000


def test_recall_falls_with_threshold(spark):
    df = spark.range(2000).select((F.rand(1)).alias("score"), (F.rand(2) > 0.5).alias("t"))
    rows = sorted((r.i, r.recall) for r in M.pr_curve(df, "score", F.col("t")).collect())
    rec = [r for _, r in rows]
    assert all(a >= b for a, b in zip(rec, rec[1:]))


def test_canonical_symmetry(spark):
    a = spark.createDataFrame([("x", "y"), ("y", "z")], "w1 string, w2 string")
    b = spark.createDataFrame([("y", "x"), ("z", "y")], "w1 string, w2 string")
    assert P.pair_in_collection(a, b, directed=False, keep=True).count() == 2
    assert P.pair_in_collection(a, b, directed=True, keep=True).count() == 0


def test_candidates_are_sub_phrases(spark):
    vocab = spark.createDataFrame([("assembler",), ("absolute assembler",), ("relocating",), ("unit test",), ("x y z",)],
                                  "term string")
    exp = spark.createDataFrame([("absolute assembler",), ("relocating  assembler",), ("unit test driver",), ("x y z",)],
                                "term string")
    got = sorted(map(tuple, P.candidate_pairs(vocab, exp).collect()))
    assert got == [
        ("assembler", "absolute assembler"), ("assembler", "relocating  assembler"),
        ("relocating", "relocating  assembler"), ("unit test", "unit test driver")]
    rel = spark.createDataFrame([("relocating  assembler", "relocating", "hyper")], "w1 string, w2 string, kind string")
    assert P.candidate_pairs(vocab, exp, rel).count() == 3


def test_candidate_count_is_linear_in_hot_tokens(spark):
    # one token shared by every expansion term: output stays one row per term
    exp = spark.createDataFrame([(f"hot w{i}",) for i in range(200)], "term string")
    vocab = spark.createDataFrame([("hot",)], "term string")
    assert P.candidate_pairs(vocab, exp).count() == 200


def test_negatives_are_valid(spark):
    vocab = spark.createDataFrame([(f"t{i}",) for i in range(30)], "term string")
    golden = spark.createDataFrame([(f"t{i}", f"t{i + 1}") for i in range(20)], "w1 string, w2 string")
    neg = P.random_negatives(spark, vocab, golden)
    assert neg.count() == 20
    assert neg.filter(F.col("w1") == F.col("w2")).count() == 0
    assert P.pair_in_collection(neg, golden, directed=False, keep=True).count() == 0


def test_stem_tokens_matches_helper(spark):
    df = spark.createDataFrame([("relational databases",), ("hopping-mad",)], "term string")
    got = {r.term: r.stems for r in stem_tokens(df, "term", "term").collect()}
    assert got == {"relational databases": [porter("relational"), porter("databases")],
                   "hopping-mad": [porter("hopping"), porter("mad")]}


def test_negatives_top_up_when_first_draws_fall_short(spark):
    vocab = spark.createDataFrame([(f"t{i}",) for i in range(4)], "term string")
    golden = spark.createDataFrame([("t0", "t1"), ("t1", "t2"), ("t2", "t3"), ("t0", "t2"), ("t1", "t3")],
                                   "w1 string, w2 string")
    # only (t0, t3) in either order is a valid negative, and one draw per golden pair is not enough
    neg = P.random_negatives(spark, vocab, golden, factor=1)
    rows = neg.collect()
    assert len(rows) == 5 and all({r.w1, r.w2} == {"t0", "t3"} for r in rows)
