"""Sinks (K1-K5, K8-K12) and directory sources (S15, S16) as DataFrame writers.

Every writer is a plain ``DataFrameWriter`` call: the cluster writes in
parallel, one file set per task; nothing passes through the driver.
"""
from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written


# K1
def write_metrics_csv(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    metrics.select("recall", "precision", "f1", "accuracy", *[c for c in metrics.columns
                                                             if c not in ("recall", "precision", "f1", "accuracy")]) \
        .write.mode(mode).option("header", True).csv(path)


# K2
def write_predictions(pred: DataFrame, path: str, parts=("model", "run", "fold"), mode: str = "overwrite") -> None:
    cols = [c for c in parts if c in pred.columns]
    pred.write.mode(mode).partitionBy(*cols).parquet(path)


# K3 / K11 / S16
def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_scores_with_codec(scores: DataFrame, codec: DataFrame, path: str) -> None:
    """Scored pairs and their label codec as two tables under one folder."""
    write_table(scores, f"{path}/scores")
    write_table(codec, f"{path}/codec")


# K4 + A12
def write_threshold_fanout(fanout: DataFrame, path: str) -> None:
    """One folder per threshold, plus a count table (the reference's footer)."""
    fanout.write.mode("overwrite").partitionBy("threshold").parquet(f"{path}/pairs")
    fanout.groupBy("threshold").agg(F.count(F.lit(1)).alias("n_above")).write.mode("overwrite").parquet(f"{path}/counts")


# K5 + K12
def write_pages(pages: DataFrame, path: str, resume: bool = False) -> None:
    """Page texts partitioned by (mission, query). ``resume`` appends; otherwise
    only the partitions present in ``pages`` are replaced (dynamic overwrite)."""
    w = pages.select("mission", "query", "text").write.partitionBy("mission", "query")
    if resume:
        w.mode("append").text(path)
    else:
        w.mode("overwrite").option("partitionOverwriteMode", "dynamic").text(path)


# K8
def create_table_if_not_exists(spark: SparkSession, name: str, ddl: str, location: str | None = None) -> None:
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet{loc}")


def drop_table_if_exists(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


# K10
def write_glossary(defs: DataFrame, path: str) -> None:
    defs.select(F.concat_ws(":", "term", "definition").alias("value")).write.mode("overwrite").text(path)


# S15
def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """All files under a folder that are not empty: (path, extension, length, content)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.lower(T.file_extension(F.col("path"))).alias("extension"), "length", "content")


def convert_directory(files: DataFrame, parsers: dict[str, Callable[[bytes], str]],
                      done: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """S15 + K9: dispatch files by extension to user parsers (bytes -> text) in ``mapInPandas``.

    -> (path, text) and the rejects (path, extension, reason): unknown extensions, and files whose parser
    failed. Files whose path is already in ``done`` (path column) are skipped with an anti join. The parsed files
    are written once, so a parser runs once for a file whichever table is used."""
    if done is not None:
        files = files.join(done.select("path"), "path", "left_anti")
    known = list(parsers)
    unknown = files.filter(~F.coalesce(F.col("extension").isin(known), F.lit(False))).select("path", "extension", F.lit("no parser").alias("reason"))
    todo = files.filter(F.col("extension").isin(known)).select("path", "extension", "content")

    def parsed(extension: str, content: bytes) -> tuple[str | None, str | None]:
        try:
            return parsers[extension](bytes(content)), None
        except Exception as wrong:  # a user parser may fail in any way; its file is rejected, the others go on
            return None, f"{type(wrong).__name__}: {wrong}"[:500]

    def run(batches):
        for pdf in batches:
            for path, extension, content in zip(pdf["path"], pdf["extension"], pdf["content"]):  # one parsed file is held at a time
                text, reason = parsed(extension, content)
                yield pd.DataFrame({"path": [path], "extension": [extension], "text": pd.Series([text], dtype=object), "reason": pd.Series([reason], dtype=object)})

    out = written(todo.mapInPandas(run, "path string, extension string, text string, reason string"), "converted")
    return out.filter("reason IS NULL").select("path", "text"), unknown.unionByName(out.filter("reason IS NOT NULL").select("path", "extension", "reason"))
