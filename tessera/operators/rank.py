"""Global ordering helpers that never put all rows in one task.

``row_number() over (order by k)`` without a partition moves every row to a
single task. Instead rows are split by a *bucket* that is monotone in the sort
key; rows are numbered inside each bucket with a partitioned window, and each
bucket gets the prefix sum of the counts of all smaller buckets from a table
with one row per bucket. Buckets are either the leading hex digits of an md5
key (at most 16**4) or quantile ranges of a numeric key (at most ``n``, split
points from ``approxQuantile``), so the bucket table has a proven size bound
and may be broadcast.
"""
from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Hex digits of md5 used as bucket: 16**4 = 65,536 buckets at most.
MD5_BUCKET_DIGITS = 4
MAX_BROADCAST_BUCKETS = 1 << 16
# Quantile buckets for numeric orders: at least so many, and one for each so many rows.
QUANTILE_BUCKETS = 1024
ROWS_PER_BUCKET = 1_000_000


def md5_key(*cols, seed: str = "") -> Column:
    """Deterministic shuffle key: md5 of seed and the columns joined by '|'."""
    parts = [F.lit(seed)] + [F.coalesce((c if isinstance(c, Column) else F.col(c)).cast("string"), F.lit(""))
                             for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def md5_int(key: Column, digits: int = 15) -> Column:
    """Non-negative integer from the leading hex digits of an md5 string."""
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("long")


def bucket_count(rows: int) -> int:
    """Buckets that keep about ``ROWS_PER_BUCKET`` rows each at any size."""
    return max(QUANTILE_BUCKETS, -(-rows // ROWS_PER_BUCKET))


def md5_digits(rows: int) -> int:
    """Leading hex digits whose buckets keep about ``ROWS_PER_BUCKET`` rows each."""
    digits = MD5_BUCKET_DIGITS
    while 16 ** digits * ROWS_PER_BUCKET < rows:
        digits += 1
    return digits


def md5_bucket(key: Column, digits: int = MD5_BUCKET_DIGITS) -> Column:
    return F.substring(key, 1, digits)


def with_quantile_bucket(df: DataFrame, col: str, out: str = "_qb", n: int = QUANTILE_BUCKETS,
                         rel_err: float | None = None) -> DataFrame:
    """Add a bucket column monotone in numeric ``col`` with at most ``n`` + 1
    values: split points are approximate quantiles (one small job; the driver
    receives at most ``n`` numbers), applied with a binary search (Bucketizer)."""
    qs = df.approxQuantile(col, [i / n for i in range(1, n)], 1 / n if rel_err is None else rel_err)
    splits = [float("-inf")] + sorted(set(float(q) for q in qs if q is not None)) + [float("inf")]
    b = Bucketizer(splits=splits, inputCol="_qb_in", outputCol=out, handleInvalid="keep")
    return b.transform(df.withColumn("_qb_in", F.col(col).cast("double"))).drop("_qb_in")


def global_rank(df: DataFrame, order_cols: list, bucket: Column, rank_col: str = "rank",
                partition_by: list[str] | None = None, bucket_bound: int | None = None) -> DataFrame:
    """Add a 0-based position over ``order_cols`` (unique within the partition).

    ``bucket`` must be monotone in ``order_cols``. Rows are numbered inside
    (partition, bucket) groups, so a hot partition key is still spread over
    many tasks; the offsets table has one row per (partition, bucket) and is
    joined back on those keys. It is broadcast only when there is no partition
    key and the caller states a bucket bound (md5 / quantile buckets)."""
    part = list(partition_by or [])
    b = df.withColumn("_bucket", bucket)
    w = Window.partitionBy(*part, "_bucket").orderBy(*order_cols)
    local = b.withColumn("_local", F.row_number().over(w) - 1)
    counts = b.groupBy(*part, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    ow = (Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))).orderBy("_bucket") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(ow), F.lit(0))).select(*part, "_bucket", "_offset")
    if not part and bucket_bound is not None and bucket_bound <= MAX_BROADCAST_BUCKETS:
        offsets = F.broadcast(offsets)
    return (local.join(offsets, part + ["_bucket"])
            .withColumn(rank_col, (F.col("_local") + F.col("_offset")).cast("long"))
            .drop("_bucket", "_local", "_offset"))


def numeric_rank(df: DataFrame, order: str, rank_col: str = "rank", partition_by: list[str] | None = None,
                 n: int | None = None) -> DataFrame:
    """``global_rank`` over a unique numeric order using quantile buckets (default: by the row count)."""
    n = bucket_count(df.count()) if n is None else n
    q = with_quantile_bucket(df, order, "_qb", n)
    return global_rank(q, [order], F.col("_qb"), rank_col, partition_by, bucket_bound=n + 1).drop("_qb")


def blocked_cumsum(df: DataFrame, value: Column, order_col: str, out: str, partition_by: list[str] | None = None,
                   n: int | None = None) -> DataFrame:
    """Running sum of ``value`` over numeric ``order_col`` (unique within the
    partition), inclusive: a running sum inside quantile blocks plus the total
    of all earlier blocks. No task holds more than one block of one key,
    however large the key; the block table has at most n + 1 rows per key."""
    part = list(partition_by or [])
    n = bucket_count(df.count()) if n is None else n
    b = with_quantile_bucket(df.withColumn("_v", value), order_col, "_blk", n)
    w = Window.partitionBy(*part, "_blk").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    local = b.withColumn("_loc", F.sum("_v").over(w))
    tot = b.groupBy(*part, "_blk").agg(F.sum("_v").alias("_t"))
    ow = (Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))).orderBy("_blk") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.withColumn("_off", F.coalesce(F.sum("_t").over(ow), F.lit(0))).select(*part, "_blk", "_off")
    return (local.join(offs, part + ["_blk"])
            .withColumn(out, F.col("_loc") + F.col("_off")).drop("_v", "_blk", "_loc", "_off"))
