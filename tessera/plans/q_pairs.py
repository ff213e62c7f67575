"""Registered relation / pair queries (2.5-2.7) over the bound part terms."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import pairs as P
from . import bindings as B
from . import duck as D
from .catalog import _SCORED_SQL, register, scored_candidates
from .sql_bindings import with_

# Judgement codes -> (class, swap). Any other code counts as "none".
JUDGEMENT_CODES = [("s", "synonym", False), ("unknown", "unknown", False), ("re", "related", False),
                   ("hyper", "hyper", False), ("hypon", "hyper", True)]
# Code written for each relation file when judged lines are made from relations.
CODE_OF_KIND = {"synonym": "s", "related": "re", "contrast": "not"}
NEG_SEED = "neg"
NEG_FACTOR = 4


# J2
@register("relations_all", with_("relations") + "SELECT w1, w2, kind FROM relations")
def relations_all(spark, d):
    return B.relations(spark, d)


# A1 (+ S2, S3)
@register("golden_pairs", with_("golden") + "SELECT w1, w2, seq FROM golden")
def golden_pairs(spark, d):
    return B.golden(spark, d)


# J1 + J3: sub-phrase candidates that are not golden pairs (either order)
@register("candidates_not_golden", with_("candidates", "golden") + """
    SELECT c.w1, c.w2 FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM golden g
      WHERE least(g.w1, g.w2) = least(c.w1, c.w2) AND greatest(g.w1, g.w2) = greatest(c.w1, c.w2))""")
def candidates_not_golden(spark, d):
    cands = P.candidate_pairs(B.vocabulary(spark, d), B.terms(spark, d))
    return P.not_in_golden(cands, B.golden(spark, d))


# P1 + P3 + P4 + T15 over golden pairs
@register("golden_pair_flags", with_("golden") + f"""
    SELECT w1, w2, w1 || '|' || w2 AS pair_key,
      ({D.term_tokens('w1')}[1] = {D.term_tokens('w2')}[1] OR {D.term_tokens('w1')}[-1] = {D.term_tokens('w2')}[-1]) AS heuristic,
      len(list_intersect({D.term_tokens('w1')}, {D.term_tokens('w2')})) > 0 AS share_token,
      w1 <> w2 AS not_self FROM golden""")
def golden_pair_flags(spark, d):
    g = B.golden(spark, d)
    return g.select("w1", "w2", T.compound_key("w1", "w2").alias("pair_key"),
                    P.same_first_or_last_token(F.col("w1"), F.col("w2")).alias("heuristic"),
                    P.share_tokens(T.term_tokens("w1"), T.term_tokens("w2")).alias("share_token"),
                    P.not_self().alias("not_self"))


# P5: reversed golden pairs against golden, directed and undirected
@register("membership_directed", with_("golden") + """
    SELECT DISTINCT r.w1, r.w2 FROM (SELECT w2 AS w1, w1 AS w2 FROM golden) r
    JOIN golden g ON g.w1 = r.w1 AND g.w2 = r.w2""")
def membership_directed(spark, d):
    g = B.golden(spark, d)
    rev = g.select(F.col("w2").alias("w1"), F.col("w1").alias("w2"))
    return P.pair_in_collection(rev, g, directed=True, keep=True).distinct()


@register("membership_undirected_anti", with_("relations", "golden") + """
    SELECT r.w1, r.w2, r.kind FROM relations r WHERE NOT EXISTS (SELECT 1 FROM golden g
      WHERE least(g.w1, g.w2) = least(r.w1, r.w2) AND greatest(g.w1, g.w2) = greatest(r.w1, r.w2))""")
def membership_undirected_anti(spark, d):
    return P.pair_in_collection(B.relations(spark, d), B.golden(spark, d), directed=False, keep=False)


# Random negatives, as many as golden pairs
NEG_CTES = [
    f"neg_idx AS (SELECT term, row_number() OVER (ORDER BY md5('{NEG_SEED}|' || term)) - 1 AS idx FROM terms)",
    "neg_v AS (SELECT count(*) AS v FROM neg_idx)",
    "neg_n AS (SELECT count(*) AS n FROM golden)",
    f"""neg_draws AS (SELECT draw,
          {D.md5_int(f"md5('{NEG_SEED}|' || CAST(draw AS VARCHAR) || '|a')")} % v AS i1,
          {D.md5_int(f"md5('{NEG_SEED}|' || CAST(draw AS VARCHAR) || '|b')")} % v AS i2
        FROM (SELECT unnest(range(n * {NEG_FACTOR})) AS draw FROM neg_n), neg_v)""",
    """neg_cand AS (SELECT d.draw, a.term AS w1, b.term AS w2 FROM neg_draws d JOIN neg_idx a ON a.idx = d.i1
        JOIN neg_idx b ON b.idx = d.i2
        WHERE a.term <> b.term AND NOT EXISTS (SELECT 1 FROM golden g
          WHERE least(g.w1, g.w2) = least(a.term, b.term) AND greatest(g.w1, g.w2) = greatest(a.term, b.term)))""",
    """neg AS (SELECT draw, w1, w2 FROM (SELECT *, row_number() OVER (ORDER BY draw) - 1 AS r FROM neg_cand), neg_n
        WHERE r < n)""",
]


@register("negative_pairs", with_("terms", "golden", extra=NEG_CTES) + "SELECT draw, w1, w2 FROM neg")
def negative_pairs(spark, d):
    return P.random_negatives(spark, B.terms(spark, d), B.golden(spark, d), factor=NEG_FACTOR, seed=NEG_SEED, none_left="empty")


# A5: expansion = hyponym items of the list relations
@register("expansion_stats", with_("terms", "list_rows") + """
    SELECT 'expansion' AS stat, count(DISTINCT w2) AS n FROM list_rows
    UNION ALL SELECT 'vocab_only', count(*) FROM (SELECT DISTINCT term FROM terms
      WHERE term NOT IN (SELECT w2 FROM list_rows))""")
def expansion_stats(spark, d):
    lr = B.relation_pairs(spark, d).filter(F.col("kind") == "hyper").select(F.col("w2").alias("term"))
    return P.expansion_stats(B.terms(spark, d), lr)


# S13 + A4: judged pair CSV lines made from relations, counted per class
def _judged_lines(spark, d):
    r = B.relation_pairs(spark, d)
    code = F.when(F.col("kind") == "hyper", F.when(F.col("w1") > F.col("w2"), F.lit("hypon")).otherwise(F.lit("hyper")))
    for k, c in CODE_OF_KIND.items():
        code = code.when(F.col("kind") == k, F.lit(c))
    a = F.when((F.col("kind") == "hyper") & (F.col("w1") > F.col("w2")), F.col("w2")).otherwise(F.col("w1"))
    b = F.when((F.col("kind") == "hyper") & (F.col("w1") > F.col("w2")), F.col("w1")).otherwise(F.col("w2"))
    return r.select("seq", F.concat_ws(",", a, b, code.otherwise(F.lit("not"))).alias("value"))


def _codes(spark):
    return spark.createDataFrame(JUDGEMENT_CODES, "code string, cls string, swap boolean")


@register("judged_label_counts", with_("rel_rows", extra=[
    f"""lines AS (SELECT seq, concat_ws(',',
          CASE WHEN kind = 'hyper' AND w1 > w2 THEN w2 ELSE w1 END,
          CASE WHEN kind = 'hyper' AND w1 > w2 THEN w1 ELSE w2 END,
          CASE WHEN kind = 'hyper' THEN (CASE WHEN w1 > w2 THEN 'hypon' ELSE 'hyper' END)
               {' '.join(f"WHEN kind = {D.q(k)} THEN {D.q(c)}" for k, c in CODE_OF_KIND.items())} ELSE 'not' END) AS value
        FROM rel_rows)""",
    "parsed AS (SELECT string_split(value, ',') AS p FROM lines WHERE len(string_split(value, ',')) = 3)",
    "codes AS (SELECT * FROM (VALUES " + ", ".join(f"({D.q(c)}, {D.q(k)}, {str(s).upper()})" for c, k, s in JUDGEMENT_CODES)
    + ") AS t(code, cls, swap))"]) + """
    SELECT coalesce(c.cls, 'none') AS cls,
      count(DISTINCT (CASE WHEN coalesce(c.swap, false) THEN p[2] ELSE p[1] END,
                      CASE WHEN coalesce(c.swap, false) THEN p[1] ELSE p[2] END)) AS n_pairs
    FROM parsed LEFT JOIN codes c ON c.code = p[3] GROUP BY 1""")
def judged_label_counts(spark, d):
    lines = _judged_lines(spark, d)
    parts = lines.withColumn("_p", F.split("value", ",", -1)).filter(F.size("_p") == 3)
    judged = parts.select(T.at("_p", 1).alias("w1"), T.at("_p", 2).alias("w2"), T.at("_p", 3).alias("code"))
    return P.judged_label_counts(judged, _codes(spark))


# A2 + A3: unordered first-seen dedupe of all scored candidates (both orders present)
@register("scored_pairs_dedupe", _SCORED_SQL + """
    SELECT arg_min(w1, seq) AS w1, arg_min(w2, seq) AS w2, arg_min(score, seq) AS score
    FROM (SELECT *, w1 || '|' || w2 AS seq FROM scored WHERE w1 <> w2) GROUP BY least(w1, w2), greatest(w1, w2)""")
def scored_pairs_dedupe(spark, d):
    s = scored_candidates(spark, d).withColumn("seq", F.concat_ws("|", "w1", "w2"))
    return P.dedupe_results(s, "seq", ["score"]).drop("seq")
