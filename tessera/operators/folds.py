"""Sharding, deterministic shuffles, folds and slices.

Randomness is an md5 of (seed, key) so every engine can repeat it; global
positions come from ``rank.global_rank`` (no single-task window).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import global_rank, md5_bucket, md5_digits, md5_int, md5_key, numeric_rank


# O3
def shard(df: DataFrame, key: str, total: int, node: int) -> DataFrame:
    """Rows of shard ``node`` (1-based) out of ``total`` by md5 of the key.
    Spark partitions replace this inside one job; it is kept for users who
    slice work across separate jobs."""
    return df.filter(F.pmod(md5_int(F.md5(F.col(key).cast("string"))), F.lit(total)) == F.lit(node - 1))


# O4 + W1
def round_robin(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """Part index of each item: items of a key are dealt round robin into n
    parts in their order (the index restarts for every key). ``order`` is a
    unique numeric position within the key; positions are computed in quantile
    blocks so a hot key is not numbered by a single task."""
    ranked = numeric_rank(df, order, "_pos", partition_by=[key])
    return ranked.withColumn("part", F.pmod(F.col("_pos"), F.lit(n))).drop("_pos")


# O5
def shuffle_key(*cols, seed: str = "shuffle") -> Column:
    """Sort key of a deterministic random order."""
    return md5_key(*cols, seed=seed)


# O6
def ten_folds(df: DataFrame, key_cols: list[str], seed: str = "folds", k: int = 10,
              n: int | None = None) -> DataFrame:
    """Equal folds: rows ranked by md5(seed|key), fold = rank div floor(n/k),
    rows past k*floor(n/k) dropped. Raises if n < k.

    Ranking uses bucketed row numbers plus bucket offsets (no global window).
    The ``fold`` column gives test membership; training rows of fold f are the
    rows with ``fold != f``."""
    if n is None:
        n = df.count()
    size = n // k
    if size == 0:
        raise ValueError(f"need at least {k} rows for {k} folds, got {n}")
    keyed = df.withColumn("_h", md5_key(*key_cols, seed=seed))
    ranked = global_rank(keyed, ["_h"], md5_bucket(F.col("_h"), md5_digits(n)), "_rank", bucket_bound=16 ** md5_digits(n))
    return (ranked.withColumn("fold", (F.col("_rank") / F.lit(size)).cast("int"))
            .filter(F.col("fold") < k).drop("_h", "_rank"))


def hash_folds(df: DataFrame, key_cols: list[str], seed: str = "folds", k: int = 10) -> DataFrame:
    """Cheap mode: fold = md5 bits mod k (sizes about equal, nothing dropped)."""
    return df.withColumn("fold", F.pmod(md5_int(md5_key(*key_cols, seed=seed)), F.lit(k)).cast("int"))


# O7
def slice_parts(df: DataFrame, order: str, parts: int = 10, n: int | None = None) -> DataFrame:
    """Slice rows ordered by a unique numeric ``order`` into ``parts`` equal parts
    (remainder dropped); part = position div floor(n/parts)."""
    if n is None:
        n = df.count()
    size = n // parts
    if size == 0:
        raise ValueError(f"need at least {parts} rows for {parts} parts, got {n}")
    ranked = numeric_rank(df, order, "_pos")
    return (ranked.withColumn("part", (F.col("_pos") / F.lit(size)).cast("int"))
            .filter(F.col("part") < parts).drop("_pos"))
