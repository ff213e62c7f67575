"""Incremental keyed upsert of a stream into a store table.

Layout under ``<store>``: ``delta/epoch=<n>`` holds the last row per key of
micro-batch n (written by that batch alone, so a batch costs O(batch), not
O(store)); every ``compact_every`` epochs the merged view is written once as
``base/epoch=<n>``. Reading merges the newest complete base with the deltas
after it, last wins per key by (version, tiebreak).

A replayed epoch rewrites its own delta from the same rows, and last-wins is
idempotent, so the store is exactly-once per (key, version).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import store as ST


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def _epochs(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """Complete (``_SUCCESS``) epoch folders, ascending. Only the folder listing
    (one entry per epoch) reaches the driver."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith("epoch=") and fs.exists(st.getPath().suffix("/_SUCCESS")):
            out.append((int(name.split("=", 1)[1]), st.getPath().toString()))
    return sorted(out)


def read_store(spark: SparkSession, store: str, schema, keys: list[str], version: str,
               tiebreak: str | None = None) -> DataFrame:
    bases = _epochs(spark, f"{store}/base")
    start = bases[-1][0] if bases else -1
    paths = ([bases[-1][1]] if bases else []) + [p for e, p in _epochs(spark, f"{store}/delta") if e > start]
    if not paths:
        return spark.createDataFrame([], schema)
    return ST.latest_per_key(spark.read.schema(schema).parquet(*paths), keys, version, tiebreak)


def upsert_stream(stream: DataFrame, store: str, keys: list[str], version: str, tiebreak: str | None,
                  checkpoint: str, trigger_available_now: bool = True, compact_every: int = 10):
    """Start the streaming upsert; returns the StreamingQuery."""
    schema = stream.schema

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        ST.latest_per_key(batch, keys, version, tiebreak).write.mode("overwrite").parquet(
            f"{store}/delta/epoch={epoch:012d}")
        if compact_every and epoch > 0 and epoch % compact_every == 0:
            read_store(spark, store, schema, keys, version, tiebreak).write.mode("overwrite").parquet(
                f"{store}/base/epoch={epoch:012d}")

    w = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_available_now else w
    return w.start()
