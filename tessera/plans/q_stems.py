"""Registered stem-based queries (J5, P2, P3, F14-F16 on stems): native stems, each with its DuckDB twin."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stem_native as SN
from ..functions import text as T
from ..operators import features as FT
from ..operators import pairs as P
from . import bindings as B
from . import duck as D
from .catalog import register
from .duck_stem import stems
from .sql_bindings import with_

TERM_STEMS_SQL = [f"term_tok AS (SELECT term, unnest(t) AS tok, unnest(range(len(t))) AS pos FROM (SELECT term, {D.split_tokens('term')} AS t FROM terms))",
                  *stems("term_tok"),
                  "term_stem AS (SELECT term, list(stem ORDER BY pos) AS stems FROM term_tok JOIN stem_of USING (tok) GROUP BY term)"]


def _term_stems(spark, d):
    terms = B.terms(spark, d)
    return SN.stems_of(terms.select("term", T.split_tokens("term").alias("tokens")))


# Stems of every term (each distinct token stemmed once)
@register("term_stems", with_("terms", extra=TERM_STEMS_SQL) + "SELECT term, stems FROM term_stem")
def term_stems(spark, d):
    return _term_stems(spark, d)


# J5 over whole documents: distinct-token stemming of all document words
@register("document_stem_counts", "WITH " + ",\n".join([
    f"doc_tok AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), {D.rx('[' + T.WORD + ']+')}))) AS tok FROM documents)", *stems("doc_tok")])
    + " SELECT doc_id, count(DISTINCT stem) AS n_stems, count(*) AS n_tokens FROM doc_tok JOIN stem_of USING (tok) GROUP BY doc_id")
def document_stem_counts(spark, d):
    docs = B.table(spark, d, "documents")
    # Distinct tokens per document first (map-side), so the join to stems and the counts see each (document, token) once.
    toks = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[" + T.WORD + "]+"), F.lit(0)))).alias("tok"))
    found = SN.stem_words(toks.select("tok").distinct())
    # Dealt by document once: stems are counted, then summed, where they are.
    stems = toks.join(found, "tok").select("doc_id", "stem").repartition("doc_id").groupBy("doc_id", "stem").agg(F.count(F.lit(1)).alias("n"))
    return stems.groupBy("doc_id").agg(F.count("stem").alias("n_stems"), F.sum("n").alias("n_tokens"))


# P2 + P3 + F14-F16 on stems of golden pairs
@register("golden_stem_flags", with_("golden", "terms", extra=TERM_STEMS_SQL) + """
    SELECT g.w1, g.w2, (a.stems[1] = b.stems[1] OR a.stems[-1] = b.stems[-1]) AS heuristic, len(list_intersect(a.stems, b.stems)) > 0 AS share_stem,
      CAST(len(list_intersect(a.stems, b.stems)) AS INTEGER) AS common_stems, CAST(a.stems[-1] = b.stems[-1] AS INTEGER) AS same_last_stem,
      CAST(a.stems[1] = b.stems[1] AS INTEGER) AS same_first_stem
    FROM golden g JOIN term_stem a ON a.term = g.w1 JOIN term_stem b ON b.term = g.w2""")
def golden_stem_flags(spark, d):
    s = _term_stems(spark, d)
    g = B.golden(spark, d).select("w1", "w2")
    g = (g.join(s.select(F.col("term").alias("w1"), F.col("stems").alias("s1")), "w1")
         .join(s.select(F.col("term").alias("w2"), F.col("stems").alias("s2")), "w2"))
    return g.select("w1", "w2", P.same_first_or_last(F.col("s1"), F.col("s2")).alias("heuristic"),
                    P.share_tokens(F.col("s1"), F.col("s2")).alias("share_stem"),
                    FT.common_token_len("s1", "s2").alias("common_stems"),
                    FT.same_last_token("s1", "s2").alias("same_last_stem"),
                    FT.same_first_token("s1", "s2").alias("same_first_stem"))
