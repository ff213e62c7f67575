"""Golden tests from the worked values (small fixtures made here)."""
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import features as FT
from tessera.operators import folds as O
from tessera.operators import metrics as M
from tessera.operators import models as MD
from tessera.operators import pairs as P
from tessera.sources import relations as R


def one(spark, expr, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col(schema.split()[0])).alias("o")).first()["o"]


def test_clean_phrase(spark):
    assert one(spark, T.clean_phrase, "  one-plus-one  address ") == "one-plus-one address"
    assert one(spark, T.clean_phrase, "dependent entity [key style]") == "dependent entity key style "
    assert one(spark, T.clean_phrase, "C# & C++") == "C & C "
    assert one(spark, T.clean_phrase, "élève  (x)") == "élève x "


def test_keep_only_given_chars_keeps_line_breaks(spark):
    assert one(spark, T.keep_only_given_chars, "a\tb\n\nc") == "a b\n\nc"
    assert one(spark, T.keep_only_given_chars, "C# & C++") == "C & C "


def test_space_around_char_and_brackets(spark):
    assert one(spark, T.remove_space_around_char, "health - care") == "health-care"
    assert one(spark, T.remove_content_in_bracket, "a[b]c[d]") == "a c "
    assert one(spark, T.remove_content_in_bracket, "f(x]y") == "f y"
    assert one(spark, T.remove_content_in_bracket, "a(b[c]d)e") == "a d)e"
    assert one(spark, T.remove_content_in_bracket, "open (never closed") == "open (never closed"


def test_split_keeps_empty_tokens(spark):
    assert one(spark, T.split_tokens, "a-b  c") == ["a", "b", "", "c"]


def test_query_text(spark):
    df = spark.createDataFrame([("what is {} in {}", ["taskboard", "agile"], "example.org")],
                               "t string, terms array<string>, d string")
    got = df.select(T.query_text(F.col("t"), F.col("terms"), F.col("d")).alias("q")).first()["q"]
    assert got == "what is taskboard in agile site:example.org"


def test_stop_words(spark):
    assert one(spark, T.remove_stop_words, "The cat, and THE dog") == "cat , dog"


def test_definition_last_colon_last_line_wins(spark):
    lines = spark.createDataFrame([(1, "a:b:c"), (2, "x:first"), (3, "x:second")], "line_no long, value string")
    got = {r["term"]: r["definition"] for r in R.parse_definition_lines(lines).collect()}
    assert got == {"a:b": "c", "x": "second"}


def test_pair_and_list_lines(spark):
    lines = spark.createDataFrame([(1, "a, b"), (2, "only"), (3, "x,y,z")], "line_no long, value string")
    ok, bad = R.parse_pair_lines(lines)
    assert [(r.w1, r.w2) for r in ok.collect()] == [("a", "b")]
    assert sorted(r.line_no for r in bad.collect()) == [2, 3]
    lst = spark.createDataFrame([(1, "root: a, b"), (2, "empty:")], "line_no long, value string")
    items, _ = R.parse_list_lines(lst)
    assert sorted((r.w1, r.w2) for r in items.collect()) == [("root", "a"), ("root", "b")]


def test_term_count_in_text(spark):
    df = spark.createDataFrame([("the", " the the the ")], "w string, t string")
    assert df.select(FT.term_count_in_text("w", "t").alias("n")).first()["n"] == 2
    df = spark.createDataFrame([("C++", " use C++ daily ")], "w string, t string")
    assert df.select(FT.term_count_in_text("w", "t").alias("n")).first()["n"] == 1


def test_edit_distance(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("élève", "eleve")], "a string, b string")
    assert [r.d for r in df.select(FT.edit_distance("a", "b").alias("d")).collect()] == [3, 2]


def test_ratios_rules(spark):
    df = spark.createDataFrame([(0, 0, 5, 0), (0, 1, 1, 2)], "tp long, fp long, tn long, fn long")
    got = [(r.recall, r.precision, r.f1, r.accuracy) for r in M.ratios(df).collect()]
    assert got == [(1.0, 1.0, 1.0, 1.0), (0.0, 0.0, 0.0, 0.25)]


def test_round_robin(spark):
    df = spark.createDataFrame([("k1", i, v) for i, v in enumerate([1, 2, 3, 4])] +
                               [("k2", i, v) for i, v in enumerate([5, 6, 7])], "k string, pos long, v long")
    got = sorted((r.part, r.k, r.v) for r in O.round_robin(df, "k", "pos", 2).collect())
    assert got == [(0, "k1", 1), (0, "k1", 3), (0, "k2", 5), (0, "k2", 7), (1, "k1", 2), (1, "k1", 4), (1, "k2", 6)]


def test_ten_folds_23_rows(spark):
    df = spark.range(23).withColumnRenamed("id", "k")
    f = O.ten_folds(df, ["k"])
    counts = sorted(r["count"] for r in f.groupBy("fold").count().collect())
    assert counts == [2] * 10 and f.count() == 20


def test_dedupe_first_seen(spark):
    df = spark.createDataFrame([("a", "b", 1), ("b", "a", 2), ("c", "c", 3), ("a", "b", 4)], "w1 string, w2 string, seq long")
    assert [(r.w1, r.w2) for r in P.dedupe_results(df).collect()] == [("a", "b")]
    df = spark.createDataFrame([("a", "b", 1), ("b", "a", 2)], "w1 string, w2 string, seq long")
    assert [(r.w1, r.w2) for r in P.first_seen_unordered(df).collect()] == [("a", "b")]


def test_judged_counts(spark):
    judged = spark.createDataFrame([("x", "y", "hypon"), ("y", "x", "hyper"), ("p", "q", "hypre")],
                                   "w1 string, w2 string, code string")
    codes = spark.createDataFrame([("hyper", "hyper", False), ("hypon", "hyper", True)], "code string, cls string, swap boolean")
    got = {r.cls: r.n_pairs for r in P.judged_label_counts(judged, codes).collect()}
    assert got == {"hyper": 1, "none": 1}


def test_threshold_edges(spark):
    df = spark.createDataFrame([(0.5, True)], "score double, t boolean")
    curve = {r.threshold: r.tp for r in M.pr_curve(df, "score", F.col("t")).collect()}
    assert curve[0.5] == 1 and curve[0.52] == 0
    assert M.threshold_fanout(df, "score").filter(F.col("threshold") == 0.5).count() == 0


def test_label_codec_and_one_hot(spark):
    df = spark.createDataFrame([("yes",), ("no",), ("unknow",)], "label string")
    codec = {r.label: r.idx for r in MD.label_index(df).collect()}
    assert codec == {"no": 0, "unknow": 1, "yes": 2}
    v = spark.createDataFrame([(2,)], "i int").select(MD.one_hot("i", 3).alias("v"))
    assert v.first()["v"] == [0, 0, 1]
    assert v.select(MD.one_hot_decode("v").alias("d")).first()["d"] == 2
