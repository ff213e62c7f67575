"""Registered evaluation queries
over predictions derived from the ``labels`` table by a fixed rule.

Prediction rule (per model m): u = md5 bits of "m|doc_id" scaled to [0, 1),
score = 0.35 * quality + 0.65 * u, predicted "yes" when score >= 0.5, truth is
quality = 1. Two models, m1 and m2.
"""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import folds as O
from ..operators import metrics as M
from ..operators import pairs as P
from ..operators.rank import blocked_cumsum, global_rank, md5_bucket, md5_int
from ..session import ensure_checkpoint_dir
from ..sources import lines as L
from . import duck as D
from . import bindings as B
from .catalog import _SCORED_SQL, register, scored_candidates

# Fixed values of the prediction rule.
MODELS = ["m1", "m2"]
W_QUALITY = 0.35
W_NOISE = 0.65
TWO_60 = float(2 ** 60)
FOLD_SEED = "folds"
LOG_HEADER = "label, correctness, w1, w2"
METRICS = ["recall", "precision", "f1", "accuracy"]


def predictions(spark, d):
    lab = B.table(spark, d, "labels").select("doc_id", "quality", "toxic")
    p = lab.select("*", F.explode(F.array(*[F.lit(m) for m in MODELS])).alias("model"))
    u = md5_int(F.md5(F.concat_ws("|", F.col("model"), F.col("doc_id").cast("string")))) / F.lit(TWO_60)
    p = p.withColumn("score", F.lit(W_QUALITY) * F.col("quality") + F.lit(W_NOISE) * u)
    return (p.withColumn("pred_yes", F.col("score") >= 0.5).withColumn("truth_yes", F.col("quality") == 1)
            .withColumn("label", F.when(F.col("pred_yes"), "yes").otherwise("no"))
            .withColumn("correct", F.col("pred_yes") == F.col("truth_yes")))


PRED_SQL = f"""pred AS (SELECT *, score >= 0.5 AS pred_yes, quality = 1 AS truth_yes,
      CASE WHEN score >= 0.5 THEN 'yes' ELSE 'no' END AS label, (score >= 0.5) = (quality = 1) AS correct
    FROM (SELECT doc_id, quality, toxic, model,
            {W_QUALITY} * quality + {W_NOISE} * ({D.md5_int("md5(model || '|' || CAST(doc_id AS VARCHAR))")} / {TWO_60!r}) AS score
          FROM labels, (SELECT unnest([{', '.join(D.q(m) for m in MODELS)}]) AS model)))"""


def _ratios_sql(src: str, keys: str) -> str:
    """SQL twin of metrics.ratios over a table with tp/fp/tn/fn."""
    k = f"{keys}, " if keys else ""
    return f"""SELECT {k}tp, fp, tn, fn, recall, precision,
        CASE WHEN recall + precision = 0 THEN 0.0 ELSE 2.0 * precision * recall / (precision + recall) END AS f1,
        CASE WHEN tp + fp + tn + fn = 0 THEN NULL ELSE CAST(tp + tn AS DOUBLE) / (tp + fp + tn + fn) END AS accuracy
      FROM (SELECT *, CASE WHEN tp + fn = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS recall,
                      CASE WHEN tp + fp = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS precision FROM {src})"""


def _conf_sql(src: str, keys: str, pred: str = "pred_yes", truth: str = "truth_yes") -> str:
    k = f"{keys}, " if keys else ""
    g = f" GROUP BY {keys}" if keys else ""
    return f"""(SELECT {k}CAST(count_if({pred} AND {truth}) AS BIGINT) AS tp, CAST(count_if({pred} AND NOT {truth}) AS BIGINT) AS fp,
        CAST(count_if(NOT {pred} AND NOT {truth}) AS BIGINT) AS tn, CAST(count_if(NOT {pred} AND {truth}) AS BIGINT) AS fn
        FROM {src}{g})"""


# A7 + A8
@register("eval_confusion", f"WITH {PRED_SQL} " + _ratios_sql(_conf_sql("pred", "model"), "model"))
def eval_confusion(spark, d):
    p = predictions(spark, d)
    return M.ratios(M.confusion(p, ["model"], F.col("pred_yes"), F.col("truth_yes")))


# A10: pooled over everything
@register("eval_pooled", f"WITH {PRED_SQL} " + _ratios_sql(_conf_sql("pred", ""), ""))
def eval_pooled(spark, d):
    p = predictions(spark, d)
    return M.pooled(p, F.col("pred_yes"), F.col("truth_yes"))


# O6 + A7 + A8 per fold
FOLDS_SQL = f"""folds AS (SELECT * FROM (
      SELECT *, CAST(floor((row_number() OVER (ORDER BY md5('{FOLD_SEED}|' || CAST(doc_id AS VARCHAR))) - 1)
                 / (SELECT count(*) // 10 FROM labels)) AS INTEGER) AS fold FROM labels) WHERE fold < 10)"""


def _folds(spark, d):
    lab = B.table(spark, d, "labels").select("doc_id")
    return O.ten_folds(lab, ["doc_id"], seed=FOLD_SEED)


@register("eval_folds", f"""WITH {PRED_SQL}, {FOLDS_SQL},
    pf AS (SELECT p.*, f.fold FROM pred p JOIN folds f ON f.doc_id = p.doc_id)
    """ + _ratios_sql(_conf_sql("pf", "model, fold"), "model, fold"))
def eval_folds(spark, d):
    pf = predictions(spark, d).join(_folds(spark, d), "doc_id")
    return M.ratios(M.confusion(pf, ["model", "fold"], F.col("pred_yes"), F.col("truth_yes")))


# Mean of fold metrics (fixed divisor 10), rounded to 9 places
@register("eval_fold_means", f"""WITH {PRED_SQL}, {FOLDS_SQL},
    pf AS (SELECT p.*, f.fold FROM pred p JOIN folds f ON f.doc_id = p.doc_id),
    fm AS ({_ratios_sql(_conf_sql("pf", "model, fold"), "model, fold")})
    SELECT model, {', '.join(f'round(sum({m}) / 10.0, 9) AS {m}' for m in METRICS)} FROM fm GROUP BY model""")
def eval_fold_means(spark, d):
    fm = eval_folds(spark, d)
    means = M.fold_means(fm, ["model"])
    return means.select("model", *[F.round(m, 9).alias(m) for m in METRICS])


# E3 + W4: precision-recall curve
@register("eval_pr_curve", f"""WITH {PRED_SQL},
    hist AS (SELECT model, CAST(len(list_filter([{', '.join(f'{i * 0.02:.2f}::DOUBLE' for i in range(50))}], lambda t: score >= t)) AS INTEGER) - 1 AS b,
                    count_if(truth_yes) AS pos, count_if(NOT truth_yes) AS neg FROM pred GROUP BY 1, 2),
    tot AS (SELECT model, sum(pos) AS P, sum(neg) AS N FROM hist GROUP BY model),
    grid AS (SELECT model, P, N, CAST(unnest(range(50)) AS INTEGER) AS i FROM tot),
    full_ AS (SELECT g.*, coalesce(h.pos, 0) AS pos, coalesce(h.neg, 0) AS neg FROM grid g
              LEFT JOIN hist h ON h.model = g.model AND h.b = g.i),
    cum AS (SELECT model, i, round(i * 0.02::DOUBLE, 2) AS threshold,
              sum(pos) OVER (PARTITION BY model ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS tp,
              sum(neg) OVER (PARTITION BY model ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS fp, P, N FROM full_),
    c2 AS (SELECT model, i, threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(N - fp AS BIGINT) AS tn,
               CAST(P - tp AS BIGINT) AS fn FROM cum)
    SELECT model, i, threshold, tp, fp, tn, fn,
      CASE WHEN tp + fn = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS recall,
      CASE WHEN tp + fp = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS precision FROM c2""")
def eval_pr_curve(spark, d):
    return M.pr_curve(predictions(spark, d), "score", F.col("truth_yes"), ["model"])


# E4 + A12: fan-out at fixed thresholds (strictly above)
@register("eval_fanout", f"""WITH {PRED_SQL}
    SELECT model, t AS threshold, count(*) AS n_above FROM (
      SELECT model, unnest(list_filter([{', '.join(repr(float(t)) + '::DOUBLE' for t in M.FANOUT_THRESHOLDS)}], lambda x: score > x)) AS t FROM pred)
    GROUP BY model, t""")
def eval_fanout(spark, d):
    f = M.threshold_fanout(predictions(spark, d), "score")
    return f.groupBy("model", "threshold").agg(F.count(F.lit(1)).alias("n_above"))


# True label recovered from predicted label + correctness
@register("eval_true_label", f"""WITH {PRED_SQL}
    SELECT model, label, correct, CASE WHEN correct THEN label WHEN label = 'yes' THEN 'no' ELSE 'yes' END AS true_label,
      count(*) AS n FROM pred GROUP BY 1, 2, 3, 4""")
def eval_true_label(spark, d):
    p = predictions(spark, d).withColumn("true_label", M.true_label(F.col("label"), F.col("correct")))
    return p.groupBy("model", "label", "correct", "true_label").agg(F.count(F.lit(1)).alias("n"))


# E5: two arms side by side (all rows vs non-toxic rows), fold means per arm
ARMS = ["all", "clean"]


@register("eval_compare_arms", f"""WITH {PRED_SQL}, {FOLDS_SQL},
    pf AS (SELECT p.*, f.fold FROM pred p JOIN folds f ON f.doc_id = p.doc_id),
    arms AS (SELECT *, 'all' AS arm FROM pf UNION ALL SELECT *, 'clean' AS arm FROM pf WHERE toxic = 0),
    fm AS ({_ratios_sql(_conf_sql("arms", "model, arm, fold"), "model, arm, fold")}),
    mm AS (SELECT model, arm, {', '.join(f'round(sum({m}) / 10.0, 9) AS {m}' for m in METRICS)} FROM fm GROUP BY model, arm)
    SELECT model, {', '.join(f"max({m}) FILTER (WHERE arm = '{a}') AS {a}_{m}" for a in ARMS for m in METRICS)}
    FROM mm GROUP BY model""")
def eval_compare_arms(spark, d):
    pf = predictions(spark, d).join(_folds(spark, d), "doc_id")
    arms = pf.withColumn("arm", F.lit("all")).unionByName(pf.filter(F.col("toxic") == 0).withColumn("arm", F.lit("clean")))
    fm = M.ratios(M.confusion(arms, ["model", "arm", "fold"], F.col("pred_yes"), F.col("truth_yes")))
    means = M.fold_means(fm, ["model", "arm"]).select("model", "arm", *[F.round(m, 9).alias(m) for m in METRICS])
    return means.groupBy("model").pivot("arm", ARMS).agg(*[F.first(m).alias(m) for m in METRICS])


# Ordered rows sliced into 10 equal parts, metrics per part
@register("eval_slices", f"""WITH {PRED_SQL},
    sl AS (SELECT * FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY model ORDER BY doc_id) - 1)
              / ((SELECT count(*) FROM labels) // 10)) AS INTEGER) AS part FROM pred) WHERE part < 10)
    """ + _ratios_sql(_conf_sql("sl", "model, part"), "model, part"))
def eval_slices(spark, d):
    p = predictions(spark, d)
    parts = None
    for m in MODELS:
        s = O.slice_parts(p.filter(F.col("model") == m), "doc_id", 10)
        parts = s if parts is None else parts.unionByName(s)
    return M.ratios(M.confusion(parts, ["model", "part"], F.col("pred_yes"), F.col("truth_yes")))


# S10 + S11 + W2 + A8: tab prediction log with repeated fold headers
def _score_text(x):
    """``[ p_no  p_yes]``, padded as printed arrays are."""
    return F.concat(F.lit("[ "), (F.lit(1.0) - F.col(x)).cast("decimal(10,6)").cast("string"), F.lit("  "),
                    F.col(x).cast("decimal(10,6)").cast("string"), F.lit("]"))


def prediction_log(spark, d):
    """(file, line_no, value): one file per model; each fold starts with a header."""
    pf = predictions(spark, d).join(O.ten_folds(B.table(spark, d, "labels").select("doc_id"), ["doc_id"],
                                                seed=FOLD_SEED), "doc_id")
    pf = pf.withColumn("_h", F.md5(F.concat_ws("|", F.lit(FOLD_SEED), F.col("doc_id").cast("string"))))
    ranked = global_rank(pf, ["_h"], md5_bucket(F.col("_h")), "rank", partition_by=["model"])
    size_ = B.table(spark, d, "labels").count() // 10
    rows = ranked.select(F.col("model").alias("file"),
                         (F.col("rank") + F.col("fold") + 2).alias("line_no"),
                         F.concat_ws("\t", "label", F.when(F.col("correct"), "Correct").otherwise("Wrong"),
                                     _score_text("score"), F.lit(""), F.col("doc_id").cast("string"),
                                     F.col("model")).alias("value"))
    heads = (spark.range(10).select(F.col("id").cast("int").alias("fold"))
             .select(F.explode(F.array(*[F.lit(m) for m in MODELS])).alias("file"), "fold")
             .select("file", (F.col("fold") * F.lit(size_ + 1) + 1).alias("line_no"), F.lit(LOG_HEADER).alias("value")))
    return rows.unionByName(heads)


def parse_prediction_log(lines):
    """fold = running count of header lines - 1; rows under 5 fields rejected.

    Lines of ``numbered_lines`` are counted by their splits, other lines by ranges of their number."""
    is_head = F.col("value").contains(LOG_HEADER)
    if "block" in lines.columns:
        withfold = L.running_sum(lines, is_head.cast("int"), "_heads")
    else:
        withfold = blocked_cumsum(lines, is_head.cast("int"), "line_no", "_heads", ["file"])
    parts = F.filter(F.split(F.col("value"), "\t", -1), lambda x: F.length(x) > 0)
    rows = (withfold.filter(~is_head).withColumn("_p", parts).filter(F.size("_p") >= 5)
            .select(F.col("log" if "block" in lines.columns else "file").alias("file"), (F.col("_heads") - 1).alias("fold"), T.at("_p", 1).alias("label"),
                    (T.at("_p", 2) == "Correct").alias("correct"),
                    F.filter(F.split(F.regexp_replace(T.at("_p", 3), r"[\[\]]", ""), " ", -1), lambda x: x != "").alias("_s"),
                    T.at("_p", 4).alias("w1"), T.at("_p", 5).alias("w2")))
    return rows.withColumn("p_yes", T.at("_s", 2).try_cast("double")).drop("_s")


_LOG_SQL = f"""{FOLDS_SQL},
    pf AS (SELECT p.*, f.fold, row_number() OVER (PARTITION BY p.model ORDER BY md5('{FOLD_SEED}|' || CAST(p.doc_id AS VARCHAR))) - 1 AS rank
           FROM pred p JOIN folds f ON f.doc_id = p.doc_id),
    lines AS (
      SELECT model AS file, rank + fold + 2 AS line_no,
        concat_ws(chr(9), label, CASE WHEN correct THEN 'Correct' ELSE 'Wrong' END,
          '[ ' || CAST(CAST(1.0 - score AS DECIMAL(10,6)) AS VARCHAR) || '  ' || CAST(CAST(score AS DECIMAL(10,6)) AS VARCHAR) || ']',
          '', CAST(doc_id AS VARCHAR), model) AS value FROM pf
      UNION ALL
      SELECT m AS file, f * ((SELECT count(*) FROM labels) // 10 + 1) + 1 AS line_no, '{LOG_HEADER}' AS value
      FROM (SELECT unnest(range(10)) AS f), (SELECT unnest([{', '.join(D.q(m) for m in MODELS)}]) AS m)),
    heads AS (SELECT *, sum(CAST(contains(value, '{LOG_HEADER}') AS INTEGER)) OVER (PARTITION BY file ORDER BY line_no
              ROWS UNBOUNDED PRECEDING) AS h FROM lines),
    parsed AS (SELECT file, CAST(h - 1 AS BIGINT) AS fold, p[1] AS label, p[2] = 'Correct' AS correct,
                 TRY_CAST(regexp_extract(p[3], '([0-9.eE+-]+)[^0-9]*$', 1) AS DOUBLE) AS p_yes, p[4] AS w1, p[5] AS w2
               FROM (SELECT *, list_filter(string_split(value, chr(9)), lambda x: length(x) > 0) AS p FROM heads
                     WHERE NOT contains(value, '{LOG_HEADER}')) WHERE len(p) >= 5)"""


@register("log_fold_metrics", f"WITH {PRED_SQL}, {_LOG_SQL} " + _ratios_sql(_conf_sql(
    "(SELECT *, label = 'yes' AS py, (CASE WHEN correct THEN label WHEN label = 'yes' THEN 'no' ELSE 'yes' END) = 'yes' AS ty FROM parsed)",
    "file, fold", "py", "ty"), "file, fold"))
def log_fold_metrics(spark, d):
    parsed = parse_prediction_log(prediction_log(spark, d))
    parsed = parsed.withColumn("py", F.col("label") == "yes").withColumn(
        "ty", M.true_label(F.col("label"), F.col("correct")) == "yes")
    return M.ratios(M.confusion(parsed, ["file", "fold"], F.col("py"), F.col("ty")))


# S8-S11 + W2 on files: the log written as text, read in splits, numbered and counted
def _written_log(spark, d):
    """Lines of the log's part files, one folder a model, in line order."""
    path = f"{ensure_checkpoint_dir(spark)}/logs/{uuid.uuid4().hex}"
    log = prediction_log(spark, d)
    log.repartitionByRange(4, "line_no").sortWithinPartitions("file", "line_no").select(F.col("file").alias("model"), "value").write.partitionBy("model").text(path)
    return L.numbered_lines(spark, path, by_folder=True, recursive=True)


@register("log_file_lines", f"WITH {PRED_SQL}, {_LOG_SQL} SELECT file AS model, CAST(line_no AS BIGINT) AS line_no, value FROM lines")
def log_file_lines(spark, d):
    return _written_log(spark, d).select(F.regexp_extract("log", "model=([^/]*)$", 1).alias("model"), "line_no", "value")


@register("log_file_fold_metrics", f"WITH {PRED_SQL}, {_LOG_SQL} " + _ratios_sql(_conf_sql(
    "(SELECT *, label = 'yes' AS py, (CASE WHEN correct THEN label WHEN label = 'yes' THEN 'no' ELSE 'yes' END) = 'yes' AS ty FROM parsed)",
    "file, fold", "py", "ty"), "file, fold"))
def log_file_fold_metrics(spark, d):
    parsed = parse_prediction_log(_written_log(spark, d)).withColumn("file", F.regexp_extract("file", "model=([^/]*)$", 1))
    parsed = parsed.withColumn("py", F.col("label") == "yes").withColumn("ty", M.true_label(F.col("label"), F.col("correct")) == "yes")
    return M.ratios(M.confusion(parsed, ["file", "fold"], F.col("py"), F.col("ty")))


# S10 + S11: the log's rows as they are read back
@register("log_parsed_rows", f"WITH {PRED_SQL}, {_LOG_SQL} SELECT file, fold, label, correct, p_yes, w1, w2 FROM parsed")
def log_parsed_rows(spark, d):
    return parse_prediction_log(prediction_log(spark, d))


# Report lines "recall:x, precision:y, f1:z, accuracy:w" parsed back to columns
@register("report_lines", f"""WITH {PRED_SQL}, {FOLDS_SQL},
    pf AS (SELECT p.*, f.fold FROM pred p JOIN folds f ON f.doc_id = p.doc_id),
    fm AS ({_ratios_sql(_conf_sql("pf", "model, fold"), "model, fold")}),
    lines AS (SELECT model, fold, 'recall:' || CAST(CAST(recall AS DECIMAL(12,9)) AS VARCHAR) || ', precision:' ||
        CAST(CAST(precision AS DECIMAL(12,9)) AS VARCHAR) || ', f1:' || CAST(CAST(f1 AS DECIMAL(12,9)) AS VARCHAR) ||
        ', accuracy:' || CAST(CAST(accuracy AS DECIMAL(12,9)) AS VARCHAR) AS line FROM fm)
    SELECT model, fold, {', '.join(f"CAST(trim(regexp_extract(line, '{m}:([^,]*)', 1)) AS DOUBLE) AS {m}" for m in METRICS)}
    FROM lines WHERE starts_with(line, 'recall:')""")
def report_lines(spark, d):
    fm = eval_folds(spark, d)
    line = F.concat(*sum([[F.lit(("" if i == 0 else ", ") + m + ":"), F.col(m).cast("decimal(12,9)").cast("string")]
                          for i, m in enumerate(METRICS)], []))
    lines = fm.select("model", "fold", line.alias("line")).filter(F.col("line").startswith("recall:"))
    kv = F.expr("str_to_map(line, ',', ':')")
    return lines.select("model", "fold", *[F.trim(kv[F.lit(m if i == 0 else " " + m)]).cast("double").alias(m)
                                           for i, m in enumerate(METRICS)])


# S8 + O1 + O2 + A2 + E4/K4: scored-pair log of the candidates, parsed, deduped, fanned out
LOG_YES_HEADER = "yes=[0 1] no=[1 0]"
# Fixed value: the pair at the start of a line of the log.
PAIR_LINE = r"""^\(['"](.+)['"], ['"](.+)['"]\)"""


def scored_log_lines(spark, d):
    s = scored_candidates(spark, d)
    body = s.select(F.concat_ws("|", "w1", "w2").alias("line_key"),
                    F.concat(F.lit("('"), F.col("w1"), F.lit("', '"), F.col("w2"), F.lit("'),[  "),
                             (F.lit(1.0) - F.col("score")).cast("decimal(10,6)").cast("string"), F.lit("   "),
                             F.col("score").cast("decimal(10,6)").cast("string"), F.lit("]")).alias("value"))
    head = spark.range(1).select(F.lit("").alias("line_key"), F.lit(LOG_YES_HEADER).alias("value"))
    return head.unionByName(body)


def parse_scored_log(lines):
    """Positive-class index from the header line (one scalar read on the driver),
    then each pair line's words and positive score."""
    hdr = (lines.filter(F.col("value").startswith("yes="))
           .select(F.split(F.trim(F.regexp_replace("value", r"[^0-9.\s]", "")), " ", -1).alias("_h"))
           .select(F.array_position("_h", "1").alias("_pos")).first())
    if hdr is None or not hdr["_pos"]:
        raise ValueError("the log has no header line that names the positive class")
    pos = int(hdr["_pos"])
    body = lines.filter(F.col("value").startswith("("))
    nums = F.filter(F.split(F.regexp_replace(T.at(F.split("value", ",", -1), -1), r"[\[\]]", ""), " ", -1),
                    lambda x: x != F.lit(""))
    return body.select("line_key", F.regexp_extract("value", PAIR_LINE, 1).alias("w1"),
                       F.regexp_extract("value", PAIR_LINE, 2).alias("w2"),
                       T.at(nums, pos).cast("double").alias("score"))


_SLOG_SQL = _SCORED_SQL + f""",
    slines AS (SELECT w1 || '|' || w2 AS line_key, '(''' || w1 || ''', ''' || w2 || '''),[  ' ||
        CAST(CAST(1.0 - score AS DECIMAL(10,6)) AS VARCHAR) || '   ' || CAST(CAST(score AS DECIMAL(10,6)) AS VARCHAR) || ']' AS value
        FROM scored),
    sparsed AS (SELECT line_key, regexp_extract(value, {D.rx(PAIR_LINE)}, 1) AS w1, regexp_extract(value, {D.rx(PAIR_LINE)}, 2) AS w2,
        CAST(list_filter(string_split(regexp_replace(string_split(value, ',')[-1], '[\\[\\]]', '', 'g'), ' '), lambda x: x <> '')[2] AS DOUBLE) AS score
        FROM slines WHERE starts_with(value, '(')),
    sdedup AS (SELECT arg_min(w1, line_key) AS w1, arg_min(w2, line_key) AS w2, arg_min(score, line_key) AS score,
        min(line_key) AS line_key FROM sparsed WHERE w1 <> w2 GROUP BY least(w1, w2), greatest(w1, w2))"""


def _scored_log_dedup(spark, d):
    parsed = parse_scored_log(scored_log_lines(spark, d))
    return P.dedupe_results(parsed, "line_key", ["score"])


@register("scored_log_fanout", _SLOG_SQL + f"""
    SELECT t AS threshold, count(*) AS n_above FROM (
      SELECT unnest(list_filter([{', '.join(repr(float(t)) + '::DOUBLE' for t in M.FANOUT_THRESHOLDS)}], lambda x: score > x)) AS t FROM sdedup)
    GROUP BY t""")
def scored_log_fanout(spark, d):
    f = M.threshold_fanout(_scored_log_dedup(spark, d), "score")
    return f.groupBy("threshold").agg(F.count(F.lit(1)).alias("n_above"))


@register("scored_log_top", _SLOG_SQL + " SELECT w1, w2, score FROM sdedup ORDER BY score DESC, line_key LIMIT 500")
def scored_log_top(spark, d):
    return _scored_log_dedup(spark, d).orderBy(F.desc("score"), "line_key").limit(500).select("w1", "w2", "score")
