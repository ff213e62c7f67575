"""Evaluation: confusion counts, ratios, fold means, curves, threshold fan-out.

Everything is a grouped aggregate of integer counts; ratios are formed once at
the end so results do not depend on the order rows are summed in.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Curve thresholds 0.00, 0.02, ..., 0.98 (positive when score >= t)
# and fan-out thresholds (kept when score > t).
CURVE_STEP = 0.02
CURVE_POINTS = 50
FANOUT_THRESHOLDS = [0.5, 0.6, 0.7, 0.8, 0.9, 0.95]


# E1
def true_label(pred: Column, correct: Column, yes: str = "yes", no: str = "no") -> Column:
    """Real label from the predicted label and its correctness flag."""
    flip = F.when(pred == F.lit(yes), F.lit(no)).otherwise(F.lit(yes))
    return F.when(correct, pred).otherwise(flip)


# A7
def confusion(df: DataFrame, keys: list[str], pred_yes: Column, truth_yes: Column) -> DataFrame:
    """tp / fp / tn / fn per key group, as conditional counts (one aggregate)."""
    return df.groupBy(*keys).agg(
        F.count_if(pred_yes & truth_yes).alias("tp"),
        F.count_if(pred_yes & ~truth_yes).alias("fp"),
        F.count_if(~pred_yes & ~truth_yes).alias("tn"),
        F.count_if(~pred_yes & truth_yes).alias("fn"),
    )


# A8
def ratios(df: DataFrame) -> DataFrame:
    """Recall, precision, F1, accuracy from tp/fp/tn/fn.

    An empty recall or precision denominator counts as 1; F1 is 0 when both
    recall and precision are 0; accuracy of zero rows is null (no error)."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    recall = F.when((tp + fn) == 0, F.lit(1.0)).otherwise(tp / (tp + fn))
    precision = F.when((tp + fp) == 0, F.lit(1.0)).otherwise(tp / (tp + fp))
    out = df.withColumn("recall", recall).withColumn("precision", precision)
    f1 = F.when((F.col("recall") + F.col("precision")) == 0, F.lit(0.0)).otherwise(
        F.lit(2.0) * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    total = tp + fp + tn + fn
    acc = F.when(total == 0, F.lit(None).cast("double")).otherwise((tp + tn) / total)
    return out.withColumn("f1", f1).withColumn("accuracy", acc)


# A9
def fold_means(metrics: DataFrame, keys: list[str], folds: int = 10) -> DataFrame:
    """Mean of each metric over folds with a fixed divisor (missing folds count 0)."""
    return metrics.groupBy(*keys).agg(*[
        (F.sum(c) / F.lit(float(folds))).alias(c) for c in ("recall", "precision", "f1", "accuracy")])


# A10
def pooled(df: DataFrame, pred_yes: Column, truth_yes: Column, keys: list[str] | None = None) -> DataFrame:
    return ratios(confusion(df, keys or [], pred_yes, truth_yes))


# E3 + W4
def score_bucket(score: Column, step: float = CURVE_STEP, points: int = CURVE_POINTS) -> Column:
    """Index of the highest threshold that the score reaches (exactly >=), -1 if none.
    The thresholds are the decimal literals 0, step, 2 step, ..."""
    literals = F.array(*[F.lit(round(i * step, 10)) for i in range(points)])
    return F.size(F.filter(literals, lambda t: score >= t)) - 1


def pr_curve(df: DataFrame, score: str, truth_yes: Column, keys: list[str] | None = None,
             step: float = CURVE_STEP, points: int = CURVE_POINTS) -> DataFrame:
    """Recall/precision at thresholds 0, step, ..., (points-1)*step; positive when score >= t.

    Each row is bucketed once and aggregated to a histogram of at most
    ``points + 1`` rows per key; tp/fp at threshold i are running sums of the
    histogram from the top bucket down (W4). No rows x thresholds product."""
    keys = keys or []
    hist = (df.withColumn("_b", score_bucket(F.col(score), step, points)).withColumn("_t", truth_yes)
            .groupBy(*keys, "_b").agg(F.count_if(F.col("_t")).alias("_pos"), F.count_if(~F.col("_t")).alias("_neg")))
    tot = hist.groupBy(*keys).agg(F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"))
    grid = tot.select(*keys, "_P", "_N", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    full = (grid.join(hist.withColumnRenamed("_b", "i"), keys + ["i"], "left")
            .fillna(0, subset=["_pos", "_neg"]))
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(F.desc("i")) \
        .rowsBetween(Window.unboundedPreceding, 0)
    cum = (full.withColumn("tp", F.sum("_pos").over(w)).withColumn("fp", F.sum("_neg").over(w))
           .withColumn("fn", F.col("_P") - F.col("tp")).withColumn("tn", F.col("_N") - F.col("fp"))
           .withColumn("threshold", F.round(F.col("i") * F.lit(step), 2)))
    return ratios(cum.select(*keys, "i", "threshold", "tp", "fp", "tn", "fn")).drop("f1", "accuracy")


# E4 + A12
def threshold_fanout(df: DataFrame, score: str, thresholds: list[float] | None = None) -> DataFrame:
    """One output row per (row, threshold) the score is strictly above."""
    ts = F.array(*[F.lit(float(t)) for t in (thresholds or FANOUT_THRESHOLDS)])
    return df.withColumn("threshold", F.explode(F.filter(ts, lambda t: F.col(score) > t)))


def fanout_counts(df: DataFrame, score: str, thresholds: list[float] | None = None) -> DataFrame:
    """Number of rows strictly above each threshold (all thresholds listed)."""
    ts = thresholds or FANOUT_THRESHOLDS
    return df.agg(*[F.count_if(F.col(score) > F.lit(float(t))).alias(f"n_{i}") for i, t in enumerate(ts)]).select(
        F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"n_{i}").alias("n_above"))
                            for i, t in enumerate(ts)])).alias("x")).select("x.*")


# E5
def compare_arms(means: DataFrame, keys: list[str], arm: str = "arm") -> DataFrame:
    """Means of two or more arms side by side (one column per arm and metric)."""
    return means.groupBy(*keys).pivot(arm).agg(*[F.first(c).alias(c) for c in ("recall", "precision", "f1", "accuracy")])
