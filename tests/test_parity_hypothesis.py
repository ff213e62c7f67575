"""Property: every text function gives the same string in Spark as its SQL twin
(DuckDB) on random text mixing scripts, all kinds of white space, brackets and
punctuation."""
import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.plans import duck as D

ALPHABET = st.sampled_from(list("abcXYZ éèçüßΩж中 \t\n\r\x0b\x0c\xa0 　-_&'\".,:;!?()[]{}<>#+*/\\0123"))
TEXTS = st.lists(st.text(alphabet=ALPHABET, max_size=40), min_size=1, max_size=25)

PAIRS = [
    (T.merge_white_space, D.merge_ws),
    (T.keep_only_given_chars, D.keep_chars),
    (T.clean_phrase, D.clean_phrase),
    (T.remove_content_in_bracket, D.bracket),
    (T.remove_stop_words, D.remove_stop_words),
    (T.glossary_clean, D.glossary_clean),
]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=TEXTS)
def test_text_functions_match_sql_twins(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    got = df.select("i", *[f(F.col("s")).alias(f"o{k}") for k, (f, _) in enumerate(PAIRS)]).orderBy("i").collect()
    con = duckdb.connect()
    for row, t in zip(got, texts):
        sql = "SELECT " + ", ".join(f"{g('x')}" for _, g in PAIRS) + " FROM (SELECT ? AS x)"
        want = con.execute(sql, [t]).fetchone()
        assert tuple(row[1:]) == tuple(want), (t, tuple(row[1:]), want)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=TEXTS)
def test_split_and_tokens_match(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    got = df.select("i", T.split_tokens("s").alias("a"), T.term_tokens("s").alias("b")).orderBy("i").collect()
    con = duckdb.connect()
    for row, t in zip(got, texts):
        want = con.execute(f"SELECT {D.split_tokens('x')}, {D.term_tokens('x')} FROM (SELECT ? AS x)", [t]).fetchone()
        assert (list(row.a), list(row.b)) == (list(want[0]), list(want[1])), t


TERMS = st.text(alphabet=st.sampled_from(list("ab+*.?()[]$^|\\ ")), min_size=1, max_size=4)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(term=TERMS, texts=st.lists(st.text(alphabet=st.sampled_from(list("ab+*.?()[]$^|\\ \tA")), max_size=30),
                                  min_size=1, max_size=10))
def test_term_count_quotes_regex_metacharacters(spark, term, texts):
    from tessera.operators import features as FT
    from tessera.plans.q_features import _count_sql
    df = spark.createDataFrame([(i, term, t) for i, t in enumerate(texts)], "i int, w string, s string")
    got = [r.n for r in df.select("i", FT.term_count_in_text("w", "s").alias("n")).orderBy("i").collect()]
    con = duckdb.connect()
    want = [con.execute(f"SELECT {_count_sql('w', 's')} FROM (SELECT ? AS w, ? AS s)", [term, t]).fetchone()[0]
            for t in texts]
    assert got == want
