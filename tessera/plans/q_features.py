"""Registered pair-feature queries (2.10 F*) over golden pairs of the bound terms."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import features as FT
from . import bindings as B
from . import duck as D
from .catalog import register
from .sql_bindings import with_


def _tok_sql(x):
    return D.split_tokens(x)


# F14-F19, F21, F24, F25 on raw tokens (split on whitespace or hyphen)
@register("features_token", with_("golden") + f"""
    SELECT w1, w2, CAST(len(list_intersect(t1, t2)) AS INTEGER) AS common_tokens, CAST(t1[-1] = t2[-1] AS INTEGER) AS same_last,
      CAST(t1[1] = t2[1] AS INTEGER) AS same_first, CAST(len(t1) = len(t2) AS INTEGER) AS same_count,
      CAST(levenshtein(w1, w2) AS INTEGER) AS edit_distance, CAST(len(t1) = 1 AS INTEGER) + CAST(len(t2) = 1 AS INTEGER) AS single_sides,
      CAST(CASE WHEN n = 0 THEN 0 ELSE len(list_filter(range(1, n + 1), lambda i: left(ra, i) = left(rb, i))) END AS INTEGER) AS suffix_len,
      CAST(len(t1) AS INTEGER) AS n_tokens_1, CAST(len(t2) AS INTEGER) AS n_tokens_2
    FROM (SELECT *, least(length(ra), length(rb), 5) AS n FROM (
      SELECT w1, w2, {_tok_sql('w1')} AS t1, {_tok_sql('w2')} AS t2,
        reverse(coalesce({D.term_tokens('w1')}[-1], '')) AS ra, reverse(coalesce({D.term_tokens('w2')}[-1], '')) AS rb
      FROM golden))""")
def features_token(spark, d):
    g = B.golden(spark, d).select("w1", "w2").withColumn("t1", T.split_tokens("w1")).withColumn("t2", T.split_tokens("w2"))
    f = FT.pair_token_features(g)
    return f.select("w1", "w2", "common_tokens", "same_last", "same_first", "same_count", "edit_distance", "single_sides",
                    FT.same_suffix_len("w1", "w2").alias("suffix_len"),
                    FT.token_count("t1").alias("n_tokens_1"), FT.token_count("t2").alias("n_tokens_2"))


# F8, F9, F12, F13 + J8: each term against the other side's definition
def _count_sql(term, text):
    pat = f"'(?i)[{T.WS}]+\\Q' || {term} || '\\E[{T.WS}]'"
    return f"CAST(len(regexp_extract_all(coalesce({text}, ''), {pat})) AS INTEGER)"


def _see_also_sql(term, text):
    clause = D.see_also_clause(f"coalesce({text}, '')")
    items = f"list_filter(list_transform(regexp_split_to_array({clause}, ',|\\band\\b'), lambda p: {D.strip('p')}), lambda p: p <> '')"
    return f"CAST(list_contains({items}, {term}) AS INTEGER)"


@register("features_definition", with_("golden", "definitions") + f"""
    SELECT g.w1, g.w2, {_count_sql('g.w1', 'd2.definition')} AS w1_in_def2, {_count_sql('g.w2', 'd1.definition')} AS w2_in_def1,
      {_see_also_sql('g.w1', 'd2.definition')} AS w1_see_also2, {_see_also_sql('g.w2', 'd1.definition')} AS w2_see_also1
    FROM golden g LEFT JOIN definitions d1 ON d1.term = g.w1 LEFT JOIN definitions d2 ON d2.term = g.w2""")
def features_definition(spark, d):
    g = B.golden(spark, d).select("w1", "w2")
    defs = B.definitions(spark, d)
    d1 = defs.select(F.col("term").alias("w1"), F.col("definition").alias("def1"))
    d2 = defs.select(F.col("term").alias("w2"), F.col("definition").alias("def2"))
    j = g.join(d1, "w1", "left").join(d2, "w2", "left")
    return j.select("w1", "w2", FT.term_count_in_text("w1", "def2").alias("w1_in_def2"),
                    FT.term_count_in_text("w2", "def1").alias("w2_in_def1"),
                    FT.listed_in_see_also("w1", "def2").alias("w1_see_also2"),
                    FT.listed_in_see_also("w2", "def1").alias("w2_see_also1"))


# F20 (re-aimed) + J4 + A6: bag-of-words cosine of the two terms' documents
def _bags_sql(src: str, text: str = "text", where: str = "") -> str:
    w = f" WHERE {where}" if where else ""
    return f"""(SELECT term, tok, count(*) AS n FROM (
        SELECT term, unnest(regexp_extract_all(lower({text}), {D.rx('[' + T.WORD + ']+')})) AS tok FROM {src}{w})
      WHERE NOT list_contains({D.stop_list()}, tok) GROUP BY term, tok)"""


def _cosine_sql(bags: str, out: str) -> str:
    return f"""{out}_b AS {bags},
    {out}_nn AS (SELECT term, sum(n * n) AS nn FROM {out}_b GROUP BY term),
    {out}_dot AS (SELECT k.w1, k.w2, sum(b1.n * b2.n) AS dot FROM (SELECT DISTINCT w1, w2 FROM golden) k
        JOIN {out}_b b1 ON b1.term = k.w1 JOIN {out}_b b2 ON b2.term = k.w2 AND b2.tok = b1.tok GROUP BY k.w1, k.w2),
    {out} AS (SELECT k.w1, k.w2, CASE WHEN d.dot IS NULL OR n1.nn IS NULL OR n2.nn IS NULL THEN 0.0
          ELSE d.dot / sqrt(CAST(n1.nn AS DOUBLE) * CAST(n2.nn AS DOUBLE)) END AS {out}
        FROM (SELECT DISTINCT w1, w2 FROM golden) k LEFT JOIN {out}_dot d ON d.w1 = k.w1 AND d.w2 = k.w2
        LEFT JOIN {out}_nn n1 ON n1.term = k.w1 LEFT JOIN {out}_nn n2 ON n2.term = k.w2)"""


@register("features_doc_cosine", with_("golden", "term_documents", extra=[_cosine_sql(_bags_sql("term_documents"), "doc_cosine")])
          + "SELECT w1, w2, doc_cosine FROM doc_cosine")
def features_doc_cosine(spark, d):
    g = B.golden(spark, d).select("w1", "w2")
    return FT.bag_cosine(g, FT.term_bags(B.term_documents(spark, d)), "doc_cosine")


# F1 / F2 re-aimed: questions (user turns) and answers (assistant turns) per term
@register("features_qa_cosine", with_("golden", "term_turns", extra=[
    _cosine_sql(_bags_sql("term_turns", where="role = 'user'"), "q_cosine"),
    _cosine_sql(_bags_sql("term_turns", where="role = 'assistant'"), "a_cosine")])
    + "SELECT q.w1, q.w2, q.q_cosine, a.a_cosine FROM q_cosine q JOIN a_cosine a ON a.w1 = q.w1 AND a.w2 = q.w2")
def features_qa_cosine(spark, d):
    g = B.golden(spark, d).select("w1", "w2")
    turns = B.term_turns(spark, d)
    q = FT.bag_cosine(g, FT.term_bags(turns.filter(F.col("role") == "user")), "q_cosine")
    a = FT.bag_cosine(g, FT.term_bags(turns.filter(F.col("role") == "assistant")), "a_cosine")
    return q.join(a, ["w1", "w2"])


# F20 cosine on the embeddings table: each vector against the next id
@register("features_vector_cosine", """
    SELECT id1, id2, round(CASE WHEN na = 0 OR nb = 0 THEN 0.0 ELSE dot / sqrt(na * nb) END, 9) AS cosine
    FROM (SELECT a.vec_id AS id1, b.vec_id AS id2,
            list_reduce(list_transform(list_zip(a.embedding, b.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)), lambda s, y: s + y) AS dot,
            list_reduce(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), lambda s, y: s + y) AS na,
            list_reduce(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), lambda s, y: s + y) AS nb
          FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)""")
def features_vector_cosine(spark, d):
    e = B.table(spark, d, "embeddings")
    a = e.select(F.col("vec_id").alias("id1"), F.col("embedding").alias("e1"))
    b = e.select(F.col("vec_id").alias("id2"), F.col("embedding").alias("e2"))
    j = a.join(b, F.col("id2") == F.col("id1") + 1)
    return j.select("id1", "id2", F.round(FT.vector_cosine("e1", "e2"), 9).alias("cosine"))


# feature vector in fixed order (definition counts, see-also flags, token features)
VECTOR_ORDER = ["w1_in_def2", "w2_in_def1", "w1_see_also2", "w2_see_also1", "common_tokens", "same_last", "same_first",
                "same_count", "edit_distance", "single_sides"]


@register("features_vector", with_("golden", "definitions") + f"""
    SELECT l.w1, l.w2, [CAST({_count_sql('l.w1', 'd2.definition')} AS DOUBLE), CAST({_count_sql('l.w2', 'd1.definition')} AS DOUBLE),
          CAST({_see_also_sql('l.w1', 'd2.definition')} AS DOUBLE), CAST({_see_also_sql('l.w2', 'd1.definition')} AS DOUBLE),
          CAST(len(list_intersect(t1, t2)) AS DOUBLE), CAST(t1[-1] = t2[-1] AS DOUBLE), CAST(t1[1] = t2[1] AS DOUBLE),
          CAST(len(t1) = len(t2) AS DOUBLE), CAST(levenshtein(l.w1, l.w2) AS DOUBLE),
          CAST(CAST(len(t1) = 1 AS INTEGER) + CAST(len(t2) = 1 AS INTEGER) AS DOUBLE)] AS features
    FROM (SELECT w1, w2, {D.split_tokens('w1')} AS t1, {D.split_tokens('w2')} AS t2 FROM golden) l
    LEFT JOIN definitions d1 ON d1.term = l.w1 LEFT JOIN definitions d2 ON d2.term = l.w2""")
def features_vector(spark, d):
    f = features_definition(spark, d).join(features_token(spark, d), ["w1", "w2"])
    return f.select("w1", "w2", F.array(*[F.col(c).cast("double") for c in VECTOR_ORDER]).alias("features"))


def feature_vectors(spark, d, pairs):
    """F26 for arbitrary pairs (w1, w2, ...): definition and token features in
    ``VECTOR_ORDER`` as an array<double> column ``features``."""
    defs = B.definitions(spark, d)
    d1 = defs.select(F.col("term").alias("w1"), F.col("definition").alias("def1"))
    d2 = defs.select(F.col("term").alias("w2"), F.col("definition").alias("def2"))
    j = pairs.join(d1, "w1", "left").join(d2, "w2", "left")
    j = j.withColumn("t1", T.split_tokens("w1")).withColumn("t2", T.split_tokens("w2"))
    return FT.assemble(j, VECTOR_ORDER).select(*pairs.columns, "features")
