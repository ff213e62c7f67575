"""Registered coding / model queries (C1-C6, M1-M8) on the labelled pair set:
golden pairs ("yes") and random negatives ("no") with their F26 vectors,
split into ten md5-ordered folds."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds as O
from ..operators import models as MD
from ..operators import pairs as P
from . import bindings as B
from ..session import ensure_checkpoint_dir
from .catalog import register
from .q_features import VECTOR_ORDER, feature_vectors
from .q_pairs import NEG_CTES, NEG_FACTOR, NEG_SEED
from .q_features import _count_sql, _see_also_sql
from . import duck as D
from .sql_bindings import with_

FOLD_SEED = "pairfolds"


def labelled_pairs(spark, d):
    """(label, w1, w2, id, key) for golden and negative pairs (C4); golden pairs
    alone where they are all pairs of the vocabulary, as in the SQL. The golden
    set is read three times (labels, negative count, anti join), so it is
    materialised once in the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    golden = B.golden(spark, d).checkpoint(eager=True)
    g = golden.select(F.lit(MD.YES).alias("label"), "w1", "w2", F.col("seq").alias("id"))
    n = P.random_negatives(spark, B.terms(spark, d), golden, factor=NEG_FACTOR, seed=NEG_SEED, none_left="empty")
    n = n.select(F.lit(MD.NO).alias("label"), "w1", "w2", F.col("draw").alias("id"))
    u = g.unionByName(n)
    return u.withColumn("key", F.concat_ws("|", "label", "w1", "w2", F.col("id").cast("string")))


def dataset(spark, d):
    """Labelled pairs with folds and features, materialised once in the shared
    checkpoint folder so the ten fits read it instead of re-running its lineage."""
    ensure_checkpoint_dir(spark)
    lp = labelled_pairs(spark, d).checkpoint(eager=True)
    return feature_vectors(spark, d, O.ten_folds(lp, ["key"], seed=FOLD_SEED)).checkpoint(eager=True)


_LP_SQL = with_("terms", "golden", "definitions", extra=NEG_CTES + [
    f"""lp AS (SELECT 'yes' AS label, w1, w2, seq AS id FROM golden UNION ALL SELECT 'no', w1, w2, draw FROM neg)""",
    """lpk AS (SELECT *, label || '|' || w1 || '|' || w2 || '|' || CAST(id AS VARCHAR) AS key FROM lp)""",
    f"""lpf AS (SELECT * FROM (SELECT *, CAST(floor((row_number() OVER (ORDER BY md5('{FOLD_SEED}|' || key)) - 1)
          / ((SELECT count(*) FROM lpk) // 10)) AS INTEGER) AS fold FROM lpk) WHERE fold < 10)""",
    f"""ds AS (SELECT l.*, [CAST({_count_sql('l.w1', 'd2.definition')} AS DOUBLE), CAST({_count_sql('l.w2', 'd1.definition')} AS DOUBLE),
          CAST({_see_also_sql('l.w1', 'd2.definition')} AS DOUBLE), CAST({_see_also_sql('l.w2', 'd1.definition')} AS DOUBLE),
          CAST(len(list_intersect(t1, t2)) AS DOUBLE), CAST(t1[-1] = t2[-1] AS DOUBLE), CAST(t1[1] = t2[1] AS DOUBLE),
          CAST(len(t1) = len(t2) AS DOUBLE), CAST(levenshtein(l.w1, l.w2) AS DOUBLE),
          CAST(CAST(len(t1) = 1 AS INTEGER) + CAST(len(t2) = 1 AS INTEGER) AS DOUBLE)] AS features
        FROM (SELECT *, {D.split_tokens('w1')} AS t1, {D.split_tokens('w2')} AS t2 FROM lpf) l
        LEFT JOIN definitions d1 ON d1.term = l.w1 LEFT JOIN definitions d2 ON d2.term = l.w2)""",
    "codec AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT label FROM lpk))",
])


# C1
@register("label_codec", _LP_SQL + "SELECT label, idx FROM codec")
def label_codec(spark, d):
    return MD.label_index(labelled_pairs(spark, d))


# C2 + C3 + C5 + C6: codes and named feature map of every labelled pair
@register("label_coding", _LP_SQL + """
    SELECT key, label, idx, oh AS one_hot, CAST(list_position(oh, 1) - 1 AS INTEGER) AS decoded, CAST(len(features) AS INTEGER) AS vec_len,
      CAST(list_position(oh, list_max(oh)) - 1 AS INTEGER) AS argmax, features[-1] AS last_feature
    FROM (SELECT ds.*, c.idx, list_transform(range(2), lambda k: CASE WHEN k = c.idx THEN 1 ELSE 0 END) AS oh
          FROM ds JOIN codec c ON c.label = ds.label)""")
def label_coding(spark, d):
    ds = dataset(spark, d)
    codec = MD.label_index(ds)
    j = ds.join(codec, "label")
    n = len(VECTOR_ORDER)
    j = j.withColumn("one_hot", MD.one_hot("idx", 2)).withColumn("decoded", MD.one_hot_decode("one_hot"))
    return j.select("key", "label", "idx", "one_hot", "decoded", F.size("features").alias("vec_len"),
                    MD.argmax_decode("one_hot").alias("argmax"),
                    F.element_at(MD.vector_to_named_map("features"), F.lit(f"f{n - 1}")).alias("last_feature"))


def _folds_query(name: str):
    def q(spark, d):
        ds = dataset(spark, d)
        pred = MD.ten_fold(ds, MD.model_by_name(name, len(VECTOR_ORDER)), ["key"])
        return MD.fold_metrics(pred).withColumn("model", F.lit(name))
    return q


# M1-M4 + M6
for _name in ("logistic", "forest", "mlp", "svm_rff"):
    register(f"model_folds_{_name}")(_folds_query(_name))


def _guess_sql(rows: str = "") -> str:
    """Per-fold metrics of the random guess over the labelled pairs (``rows``: a further condition)."""
    return _LP_SQL + """
    , pr AS (SELECT fold, label = 'yes' AS truth_yes,
          (""" + D.md5_int("md5('guess|' || key)") + """ % 100) + 1 < 50 AS pred_yes FROM ds""" + rows + """),
    cf AS (SELECT fold, CAST(count_if(pred_yes AND truth_yes) AS BIGINT) AS tp, CAST(count_if(pred_yes AND NOT truth_yes) AS BIGINT) AS fp,
        CAST(count_if(NOT pred_yes AND NOT truth_yes) AS BIGINT) AS tn, CAST(count_if(NOT pred_yes AND truth_yes) AS BIGINT) AS fn
        FROM pr GROUP BY fold),
    rp AS (SELECT *, CASE WHEN tp + fn = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS recall,
                     CASE WHEN tp + fp = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS precision FROM cf)
    SELECT fold, tp, fp, tn, fn, recall, precision,
      CASE WHEN recall + precision = 0 THEN 0.0 ELSE 2.0 * precision * recall / (precision + recall) END AS f1,
      CASE WHEN tp + fp + tn + fn = 0 THEN NULL ELSE CAST(tp + tn AS DOUBLE) / (tp + fp + tn + fn) END AS accuracy,
      'random' AS model FROM rp"""


def _guess(ds):
    ds = ds.withColumn("y", (F.col("label") == MD.YES).cast("double"))
    return ds.withColumn("pred_yes", MD.random_guess(F.col("key"))).withColumn("truth_yes", F.col("y") == 1.0)


# M5: random baseline, per fold
@register("model_folds_random", _guess_sql())
def model_folds_random(spark, d):
    return MD.fold_metrics(_guess(dataset(spark, d))).withColumn("model", F.lit("random"))


# The same predictions, metrics per fold of the pairs that share neither first nor last token
@register("eval_non_heuristic_folds", _guess_sql(f"""
    WHERE NOT ({D.term_tokens('w1')}[1] = {D.term_tokens('w2')}[1] OR {D.term_tokens('w1')}[-1] = {D.term_tokens('w2')}[-1])"""))
def eval_non_heuristic_folds(spark, d):
    rest = dataset(spark, d).filter(~P.same_first_or_last_token(F.col("w1"), F.col("w2")))
    return MD.fold_metrics(_guess(rest)).withColumn("model", F.lit("random"))


# M7: train on all vs on non-heuristic pairs, both tested on non-heuristic pairs (logistic)
@register("model_arms_non_heuristic")
def model_arms_non_heuristic(spark, d):
    ds = dataset(spark, d).withColumn("heur", P.same_first_or_last_token(F.col("w1"), F.col("w2")))
    est = MD.logistic()
    a = MD.fold_metrics(MD.ten_fold(ds, est, ["key"], test_filter=~F.col("heur"))).withColumn("arm", F.lit("train_all"))
    b = MD.fold_metrics(MD.ten_fold(ds, est, ["key"], train_filter=~F.col("heur"), test_filter=~F.col("heur")))
    return a.unionByName(b.withColumn("arm", F.lit("train_non_heuristic")))


# M8: fit on all labelled pairs, save, load and score the candidate pairs
@register("model_batch_scores")
def model_batch_scores(spark, d):
    path = MD.fit_and_save(dataset(spark, d), MD.logistic(), MD.model_path(spark, "logistic_all"))
    cands = P.not_in_golden(P.candidate_pairs(B.vocabulary(spark, d), B.terms(spark, d)), B.golden(spark, d))
    scored = MD.batch_score(feature_vectors(spark, d, cands), path)
    return scored.select("w1", "w2", "p_no", "p_yes", (F.col("prediction") == 1.0).alias("pred_yes"))


# 3.2 candidate classification end to end: scores -> unordered dedupe (first
# seen) -> strictly-above-threshold fan-out counts and the top 500
@register("classified_fanout")
def classified_fanout(spark, d):
    from ..operators import metrics as M
    s = model_batch_scores(spark, d).withColumn("seq", F.concat_ws("|", "w1", "w2"))
    dd = P.dedupe_results(s, "seq", ["p_yes"])
    return M.threshold_fanout(dd, "p_yes").groupBy("threshold").agg(F.count(F.lit(1)).alias("n_above"))


@register("classified_top_pairs")
def classified_top_pairs(spark, d):
    s = model_batch_scores(spark, d).withColumn("seq", F.concat_ws("|", "w1", "w2"))
    dd = P.dedupe_results(s, "seq", ["p_yes"])
    return dd.orderBy(F.desc("p_yes"), "seq").limit(500).select("w1", "w2", "p_yes")
