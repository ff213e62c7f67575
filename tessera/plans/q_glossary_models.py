"""Registered model queries on all features of the glossary pairs (M1-M4, M6-M8 on F26, E2 and M7 on stems).

A pair's label is the quality label of its document. Trained scores have no SQL form; each model query
returns what its oracle can state exactly for every fold: the rows tested, the positives among them,
and how many rows got two probabilities from 0 to 1 that sum to 1 and a class that follows from them. The
metrics themselves are in ``glossary_model_metrics``."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stem_native as SN
from ..functions import text as T
from ..operators import features as FT
from ..operators import folds as O
from ..operators import metrics as M
from ..operators import models as MD
from ..session import forget, written
from . import glossary as G
from . import q_eval as E
from .catalog import register
from .q_glossary import _STEMS, material

FOLD_SEED = "glossaryfolds"
N = len(FT.ALL_FEATURES)


def dataset(spark, d):
    """(key, label, w1, w2, fold, same_first, same_last, features) of the labelled pairs, written once: every fold reads it."""
    rows = G.term_pairs(spark, d).join(G.labels(spark, d), "doc_id")
    rows = written(rows.select(F.col("doc_id").alias("key"), "w1", "w2", F.when(F.col("quality") == 1, MD.YES).otherwise(MD.NO).alias("label")), "pairs")
    pairs = rows.select("w1", "w2").distinct()
    made = FT.all_features(pairs, material(spark, d, pairs))
    vector = F.array(*[F.coalesce(F.col(n), F.lit(0.0)) for n in FT.ALL_FEATURES])
    made = made.select("w1", "w2", "same_first", "same_last", vector.alias("features"))
    ds = written(O.ten_folds(rows, ["key"], seed=FOLD_SEED).join(made, ["w1", "w2"]), "dataset")
    forget(made)  # the folds read nothing else
    return ds


def heuristic():
    """Same first or same last stem."""
    return (F.col("same_first") == 1) | (F.col("same_last") == 1)


def _checks(pred, *keys: str):
    fine = (F.col("p_yes").between(0, 1) & F.col("p_no").between(0, 1) & (F.abs(F.col("p_yes") + F.col("p_no") - 1) < 1e-9)
            & (F.col("pred_yes") == (F.col("p_yes") > F.col("p_no"))))
    return pred.groupBy(*keys, "fold").agg(F.count(F.lit(1)).alias("n_test"), F.count_if("truth_yes").alias("n_yes"), F.count_if(fine).alias("n_fine"))


_ROWS = """m_rows AS (SELECT doc_id AS key, w1, w2, quality = 1 AS yes FROM g_pairs JOIN labels USING (doc_id) WHERE quality IS NOT NULL)"""
_FOLDS = f"""m_folds AS (SELECT * FROM (SELECT *, CAST(floor((row_number() OVER (ORDER BY md5('{FOLD_SEED}|' || CAST(key AS VARCHAR))) - 1)
      / ((SELECT count(*) FROM m_rows) // 10)) AS INTEGER) AS fold FROM m_rows) WHERE fold < 10)"""
_COUNTS = "count(*) AS n_test, count(*) FILTER (yes) AS n_yes, count(*) AS n_fine"


def _folds_query(name: str):
    def q(spark, d):
        ds = dataset(spark, d)
        if name == "svm_rff":
            pred = MD.ten_fold(written(MD.with_rff(ds, N), "rff"), MD.svm_calibrated(), ["key"])
        else:
            pred = MD.ten_fold(ds, MD.model_by_name(name, N), ["key"])
        return _checks(pred).withColumn("model", F.lit(name))
    return q


# M1-M4 + M6
for _name in ("logistic", "forest", "mlp", "svm_rff"):
    register(f"glossary_folds_{_name}", G.with_([_ROWS, _FOLDS]) + f"SELECT fold, {_COUNTS}, '{_name}' AS model FROM m_folds GROUP BY fold")(_folds_query(_name))


# M7 on stems: trained on all or on non-heuristic pairs, tested on non-heuristic pairs
_HEUR = "(a.st[1] = b.st[1] OR a.st[-1] = b.st[-1])"
_TERMS = ["p AS (SELECT DISTINCT w1, w2 FROM g_pairs)", "g_terms AS (SELECT w1 AS term FROM p UNION SELECT w2 FROM p)", *_STEMS]


@register("glossary_arms_non_heuristic", G.with_([*_TERMS, _ROWS, _FOLDS]) + f"""
    SELECT arm, fold, {_COUNTS} FROM (SELECT m.*, unnest(['train_all', 'train_non_heuristic']) AS arm FROM m_folds m JOIN g_stems a ON a.term = m.w1 JOIN g_stems b ON b.term = m.w2
      WHERE NOT {_HEUR}) GROUP BY arm, fold""")
def glossary_arms_non_heuristic(spark, d):
    ds = dataset(spark, d)
    arms = None
    for arm, train in (("train_all", None), ("train_non_heuristic", ~heuristic())):
        pred = MD.ten_fold(ds, MD.logistic(), ["key"], train_filter=train, test_filter=~heuristic()).withColumn("arm", F.lit(arm))
        arms = pred if arms is None else arms.unionByName(pred)
    return _checks(arms, "arm")


# The prediction log's rows whose pairs share neither first nor last stem, metrics per model and fold
@register("eval_log_non_heuristic", G.with_([*_TERMS, E.PRED_SQL, E._LOG_SQL, f"""rest AS (SELECT x.file, x.fold, x.label = 'yes' AS py,
      (CASE WHEN x.correct THEN x.label WHEN x.label = 'yes' THEN 'no' ELSE 'yes' END) = 'yes' AS ty
      FROM parsed x JOIN g_pairs g ON g.doc_id = CAST(x.w1 AS BIGINT) JOIN g_stems a ON a.term = g.w1 JOIN g_stems b ON b.term = g.w2 WHERE NOT {_HEUR})"""])
    + E._ratios_sql(E._conf_sql("rest", "file, fold", "py", "ty"), "file, fold"))
def eval_log_non_heuristic(spark, d):
    parsed = E.parse_prediction_log(E.prediction_log(spark, d)).select("file", "fold", "label", "correct", F.col("w1").cast("long").alias("doc_id"))
    pairs = G.term_pairs(spark, d)
    terms = pairs.select(F.explode(F.array("w1", "w2")).alias("term")).distinct()
    stems = SN.stems_of(terms.select("term", T.split_tokens("term").alias("tokens")))
    side = lambda n: stems.select(F.col("term").alias(f"w{n}"), F.col("stems").alias(f"s{n}"))
    same = (T.at("s1", 1) == T.at("s2", 1)) | (T.at("s1", -1) == T.at("s2", -1))
    rest = pairs.join(side(1), "w1").join(side(2), "w2").filter(~same).select("doc_id")
    kept = parsed.join(rest, "doc_id").withColumn("py", F.col("label") == "yes").withColumn("ty", M.true_label(F.col("label"), F.col("correct")) == "yes")
    return M.ratios(M.confusion(kept, ["file", "fold"], F.col("py"), F.col("ty")))


# The metrics of one model (rows only: trained numbers have no SQL form)
@register("glossary_model_metrics")
def glossary_model_metrics(spark, d):
    return MD.fold_metrics(MD.ten_fold(dataset(spark, d), MD.logistic(), ["key"])).withColumn("model", F.lit("logistic"))
