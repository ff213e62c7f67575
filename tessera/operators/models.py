"""Label coding, Spark ML models, ten-fold train/test and batch scoring (C*, M*).

Training always runs on Spark ML estimators over the distributed data set;
the only driver loop is over the ten folds (each fit is a distributed job, as
in ``CrossValidator``). Folds come from ``folds.ten_folds`` (md5 order).
"""
from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.ml.classification import (LinearSVC, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metrics as M
from .rank import md5_int

YES, NO = "yes", "no"


# C1
def label_index(df: DataFrame, label: str = "label") -> DataFrame:
    """Sorted distinct labels -> 0..n-1 (so "no" = 0, "yes" = 1). The distinct
    label set is tiny (class names), so one ordered window over it is fine."""
    return (df.select(label).distinct()
            .withColumn("idx", (F.row_number().over(Window.orderBy(label)) - 1).cast("int")))


# C2
def one_hot(idx, n: int) -> Column:
    i = F.col(idx) if isinstance(idx, str) else idx
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.when(k == i, F.lit(1)).otherwise(F.lit(0)))


def one_hot_decode(vec) -> Column:
    v = F.col(vec) if isinstance(vec, str) else vec
    return (F.array_position(v, F.lit(1)) - 1).cast("int")


# C3
def argmax_decode(vec) -> Column:
    """Index of the first maximum of a score array."""
    v = F.col(vec) if isinstance(vec, str) else vec
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


# C6
def vector_to_named_map(vec) -> Column:
    v = F.col(vec) if isinstance(vec, str) else vec
    names = F.transform(F.sequence(F.lit(0), F.size(v) - 1), lambda i: F.concat(F.lit("f"), i.cast("string")))
    return F.map_from_arrays(names, v)


# M5
def random_guess(key: Column, seed: str = "guess", percent: int = 49) -> Column:
    """"yes" for about ``percent`` % of rows: md5 bucket 1..100 < percent + 1."""
    bucket = F.pmod(md5_int(F.md5(F.concat_ws("|", F.lit(seed), key))), F.lit(100)) + 1
    return bucket < F.lit(percent + 1)


# ---------------------------------------------------------------- estimators
def to_vector(df: DataFrame, col: str = "features", out: str = "fvec") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(col).cast("array<double>")))


def logistic(max_iter: int = 10) -> Pipeline:
    """M4: maximum entropy = multinomial logistic regression, 10 iterations."""
    return Pipeline(stages=[LogisticRegression(featuresCol="fvec", labelCol="y", maxIter=max_iter)])


def forest(depth: int = 2, trees: int = 10, seed: int = 0) -> Pipeline:
    """M3: random forest, depth 2, seed 0."""
    return Pipeline(stages=[RandomForestClassifier(featuresCol="fvec", labelCol="y", maxDepth=depth,
                                                   numTrees=trees, seed=seed)])


def mlp(n_features: int, hidden: int = 15, iters: int = 100, seed: int = 0, solver: str = "l-bfgs") -> Pipeline:
    """M1: feed-forward net n-15-2, sigmoid hidden layer, soft-max output.

    Full-batch L-BFGS by default: each iteration is one distributed pass, so a
    few dozen passes replace the reference's 200 epochs of mini-batch descent
    (``solver="gd"`` with ``stepSize`` 0.01 is available but needs far more
    passes to move)."""
    return Pipeline(stages=[MultilayerPerceptronClassifier(featuresCol="fvec", labelCol="y",
                                                           layers=[n_features, hidden, 2], solver=solver,
                                                           stepSize=0.01, maxIter=iters, blockSize=100, seed=seed)])


def rff_transformer(n_features: int, dims: int = 32, gamma: float = 0.1, seed: int = 0) -> SQLTransformer:
    """Random Fourier features of an RBF kernel as one SQL projection:
    z_k = sqrt(2/D) cos(w_k . x + b_k), w ~ N(0, 2 gamma), b ~ U(0, 2 pi).
    The weights are a fixed D x n matrix drawn once from a seeded generator
    (size bounded by D * n, independent of the data)."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2 * gamma), size=(dims, n_features))
    b = rng.uniform(0, 2 * math.pi, size=dims)
    scale = math.sqrt(2.0 / dims)
    terms = []
    for k in range(dims):
        dot = " + ".join(f"({float(w[k, j])!r}) * features[{j}]" for j in range(n_features))
        terms.append(f"{float(scale)!r} * cos({dot} + ({float(b[k])!r})) AS _rff_{k}")
    return SQLTransformer(statement=f"SELECT *, {', '.join(terms)} FROM __THIS__")


class MarginVector(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Positive-class margin of a raw prediction vector as a 1-d vector."""

    def __init__(self, inputCol: str = "_svm_raw", outputCol: str = "_margin"):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _transform(self, df: DataFrame) -> DataFrame:
        raw = vector_to_array(F.col(self.getInputCol()))
        return df.withColumn(self.getOutputCol(), array_to_vector(F.array(raw[1])))


def svm_rff(n_features: int, dims: int = 32, gamma: float = 0.1, seed: int = 0) -> Pipeline:
    """M2: RBF-kernel SVM approximated by random Fourier features + LinearSVC;
    the SVM margin is calibrated to a probability by a logistic regression."""
    return Pipeline(stages=[
        rff_transformer(n_features, dims, gamma, seed),
        VectorAssembler(inputCols=[f"_rff_{k}" for k in range(dims)], outputCol="_rffv"),
        LinearSVC(featuresCol="_rffv", labelCol="y", rawPredictionCol="_svm_raw", predictionCol="_svm_pred", maxIter=10),
        MarginVector("_svm_raw", "_margin"),
        LogisticRegression(featuresCol="_margin", labelCol="y", maxIter=10),
    ])


def with_rff(ds: DataFrame, n_features: int, dims: int = 32, gamma: float = 0.1, seed: int = 0) -> DataFrame:
    """``ds`` with the random Fourier features in place of ``features``: they do not depend on the fold, so they are made once."""
    made = rff_transformer(n_features, dims, gamma, seed).transform(ds)
    return made.select(*[c for c in ds.columns if c != "features"], F.array(*[F.col(f"_rff_{k}") for k in range(dims)]).alias("features"))


def svm_calibrated() -> Pipeline:
    """M2 on features that ``with_rff`` has made: the linear part of ``svm_rff``."""
    return Pipeline(stages=[
        LinearSVC(featuresCol="fvec", labelCol="y", rawPredictionCol="_svm_raw", predictionCol="_svm_pred", maxIter=10),
        MarginVector("_svm_raw", "_margin"),
        LogisticRegression(featuresCol="_margin", labelCol="y", maxIter=10),
    ])


def model_by_name(name: str, n_features: int) -> Pipeline:
    return {"logistic": lambda: logistic(), "forest": lambda: forest(), "mlp": lambda: mlp(n_features),
            "svm_rff": lambda: svm_rff(n_features)}[name]()


# ---------------------------------------------------------------- ten fold
def prepare(ds: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """Features array -> ML vector; label -> index y (no = 0, yes = 1)."""
    return to_vector(ds, features, "fvec").withColumn("y", (F.col(label) == YES).cast("double"))


def scored(model_df: DataFrame) -> DataFrame:
    p = vector_to_array(F.col("probability"))
    return model_df.withColumn("p_no", p[0]).withColumn("p_yes", p[1]).withColumn(
        "pred_yes", F.col("prediction") == 1.0).withColumn("truth_yes", F.col("y") == 1.0)


def spread(ds: DataFrame, rows: int = 5000, most: int = 500_000) -> DataFrame:
    """``ds`` dealt evenly over as many partitions as tasks run at once: fewer where these would hold under ``rows`` rows,
    more where over ``most``. A small table is a few Parquet row groups, and every pass of every fit would run in as many tasks."""
    n = ds.count()
    want = min(n // rows, max(ds.sparkSession.sparkContext.defaultParallelism, n // most))
    return ds.repartition(want) if want > 1 else ds


# M6
def ten_fold(ds: DataFrame, estimator: Pipeline, keys: list[str], k: int = 10, train_filter: Column | None = None,
             test_filter: Column | None = None) -> DataFrame:
    """Fit on the other folds, score the held-out fold; union of all test rows.
    ``ds`` must carry ``fold``; filters pick rows for training / testing (M7).
    Pass a materialised data set (``checkpoint`` / written table). The fits read
    one persisted copy of it, spread over the tasks; the test rows read the table itself."""
    ds = prepare(ds)
    held = spread(ds).persist()
    outs = []
    for f in range(k):
        train = held.filter(F.col("fold") != f)
        test = ds.filter(F.col("fold") == f)
        if train_filter is not None:
            train = train.filter(train_filter)
        if test_filter is not None:
            test = test.filter(test_filter)
        model = estimator.fit(train)
        outs.append(scored(model.transform(test)).select(*keys, "fold", "y", "p_no", "p_yes", "pred_yes", "truth_yes"))
    held.unpersist()
    res = outs[0]
    for o in outs[1:]:
        res = res.unionByName(o)
    return res


def fold_metrics(pred: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return M.ratios(M.confusion(pred, (keys or []) + ["fold"], F.col("pred_yes"), F.col("truth_yes")))


# M8
def fit_and_save(ds: DataFrame, estimator: Pipeline, path: str) -> str:
    estimator.fit(prepare(ds)).write().overwrite().save(path)
    return path


def batch_score(features: DataFrame, path: str) -> DataFrame:
    model = PipelineModel.load(path)
    df = to_vector(features, "features", "fvec")
    p = vector_to_array(F.col("probability"))
    return model.transform(df).withColumn("p_no", p[0]).withColumn("p_yes", p[1])


def model_path(spark, name: str) -> str:
    """A new path in the shared folder: runs side by side do not meet."""
    from ..session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/{name}-{uuid.uuid4().hex}"
