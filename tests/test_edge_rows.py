"""Edge rows: empty, null, one token, accents, quotes, unequal column counts."""
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import extract as X
from tessera.operators import features as FT
from tessera.operators import metrics as M
from tessera.operators import pairs as P
from tessera.sources import relations as R


def test_text_functions_on_empty_and_null(spark):
    df = spark.createDataFrame([("",), (None,), ("   ",), ("l'été « déjà »",)], "s string")
    out = df.select(T.clean_phrase("s").alias("c"), T.remove_stop_words("s").alias("r"), T.glossary_clean("s").alias("g"),
                    T.split_tokens("s").alias("t")).collect()
    assert out[0].c == "" and out[0].r == "" and out[0].t == [""]
    assert out[1].c is None and out[1].g is None
    assert out[2].g == ""
    assert out[3].c == "l'été déjà "


def test_one_token_pairs_and_quotes(spark):
    df = spark.createDataFrame([("cache", "caches"), ("o'brien", "o'brien law"), ("élève", "eleve")], "w1 string, w2 string")
    f = FT.pair_token_features(df.withColumn("t1", T.split_tokens("w1")).withColumn("t2", T.split_tokens("w2")))
    rows = {r.w1: r for r in f.collect()}
    assert rows["cache"].single_sides == 2 and rows["cache"].edit_distance == 1
    assert rows["o'brien"].common_tokens == 1 and rows["o'brien"].same_first == 1
    assert rows["élève"].edit_distance == 2
    assert df.select(FT.same_suffix_len("w1", "w2").alias("s")).collect()[0].s == 0


def test_unequal_column_counts_go_to_rejects(spark):
    lines = spark.createDataFrame([(1, "a,b,c"), (2, ""), (3, "x,y")], "line_no long, value string")
    ok, bad = R.parse_pair_lines(lines)
    assert [(r.w1, r.w2) for r in ok.collect()] == [("x", "y")]
    assert bad.count() == 2


def test_blank_pages_are_dropped_and_empty_fields(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<html><body>no paragraphs</body></html>")], "page_id long, html string")
    valid = X.valid_pages(pages)
    assert [r.page_id for r in valid.collect()] == [3]
    rec = X.extract_fields(pages, X.QA_RULES).orderBy("page_id").collect()
    assert all(r.questions == [] and r.answers == [] for r in rec)


def test_empty_groups_and_zero_rows(spark):
    empty = spark.createDataFrame([], "w1 string, w2 string, seq long")
    assert P.dedupe_results(empty).count() == 0
    conf = spark.createDataFrame([(0, 0, 0, 0)], "tp long, fp long, tn long, fn long")
    r = M.ratios(conf).first()
    assert (r.recall, r.precision, r.f1, r.accuracy) == (1.0, 1.0, 1.0, None)
