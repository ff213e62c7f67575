"""Registered queries over the bound test tables, each with its DuckDB twin.

``QUERIES[name] = fn(spark, sf_dir) -> DataFrame`` and ``ORACLE[name] = sql``.
A query without an oracle entry is checked by row count only (and by its own
tests against a brute-force twin on small fixtures).
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import features as FT
from ..operators import pairs as P
from . import bindings as B
from . import duck as D
from .sql_bindings import with_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ----------------------------------------------------------------- flagship
FEATURE_COLS = ["common_tokens", "same_last", "same_first", "same_count", "edit_distance", "single_sides", "score"]


def scored_candidates(spark, d) -> DataFrame:
    cands = P.candidate_pairs(B.vocabulary(spark, d), B.terms(spark, d), B.relations(spark, d))
    cands = cands.withColumn("t1", T.split_tokens("w1")).withColumn("t2", T.split_tokens("w2"))
    return FT.pair_token_features(cands).withColumn("score", FT.rule_score()).drop("t1", "t2")


def top_candidates(spark: SparkSession, d: str, k: int = 500) -> DataFrame:
    """Slice: terms -> sub-phrase candidates minus relations -> F14-F19 ->
    rule score -> unordered dedupe (first seen) -> top-k by score."""
    s = scored_candidates(spark, d).withColumn("seq", F.concat_ws("|", "w1", "w2"))
    dd = P.dedupe_results(s, "seq", FEATURE_COLS).drop("seq")
    return dd.orderBy(F.desc("score"), "w1", "w2").limit(k)


_SCORED_SQL = with_("candidates", "relations", extra=[
    """cand2 AS (SELECT c.* FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM relations r
               WHERE least(r.w1, r.w2) = least(c.w1, c.w2) AND greatest(r.w1, r.w2) = greatest(c.w1, c.w2)))""",
    f"""toks AS (SELECT w1, w2, {D.split_tokens('w1')} AS t1, {D.split_tokens('w2')} AS t2 FROM cand2)""",
    """feats AS (SELECT w1, w2, CAST(len(list_intersect(t1, t2)) AS INTEGER) AS common_tokens,
               CAST(t1[-1] = t2[-1] AS INTEGER) AS same_last, CAST(t1[1] = t2[1] AS INTEGER) AS same_first,
               CAST(len(t1) = len(t2) AS INTEGER) AS same_count, CAST(levenshtein(w1, w2) AS INTEGER) AS edit_distance,
               CAST(len(t1) = 1 AS INTEGER) + CAST(len(t2) = 1 AS INTEGER) AS single_sides FROM toks)""",
    """scored AS (SELECT *, ((2 * common_tokens + same_last + same_first + same_count) + 1.0 / (1 + edit_distance)) / 6.0 AS score
               FROM feats)""",
])

ORACLE_TOP = _SCORED_SQL + """,
dd AS (SELECT arg_min(w1, seq) AS w1, arg_min(w2, seq) AS w2, arg_min(common_tokens, seq) AS common_tokens,
              arg_min(same_last, seq) AS same_last, arg_min(same_first, seq) AS same_first,
              arg_min(same_count, seq) AS same_count, arg_min(edit_distance, seq) AS edit_distance,
              arg_min(single_sides, seq) AS single_sides, arg_min(score, seq) AS score
       FROM (SELECT *, w1 || '|' || w2 AS seq FROM scored WHERE w1 <> w2)
       GROUP BY least(w1, w2), greatest(w1, w2))
SELECT * FROM dd ORDER BY score DESC, w1, w2 LIMIT 500"""

register("flagship_top_candidates", ORACLE_TOP)(top_candidates)


_LOADED = False


def load() -> None:
    """Import the query modules so they register themselves (once)."""
    global _LOADED
    if _LOADED:
        return
    from . import q_eval, q_features, q_glossary, q_glossary_models, q_layouts, q_models, q_more, q_packs, q_pages, q_pairs, q_sinks, q_stems, q_store, q_stream, q_text  # noqa: F401
    _LOADED = True
