"""Keyed document store as tables: upsert, insert-if-absent, content lookups.

The store is a table ``(key..., content, version)``. Writes are set operations
on whole tables (or micro-batches): last-wins upsert is one aggregate over the
union of old and new rows; first-wins insert is an anti join. Both are
idempotent, so a replayed micro-batch leaves the store unchanged.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _order(version, tiebreak):
    cols = [version] + ([tiebreak] if tiebreak else [])
    return F.struct(*[F.col(c) for c in cols])


# K6
def upsert_last_wins(old: DataFrame, new: DataFrame, keys: list[str], version: str = "version",
                     tiebreak: str | None = None) -> DataFrame:
    """Union old and new rows and keep, per key, the row with the largest
    (version, tiebreak). Partial aggregation runs map-side."""
    return latest_per_key(old.unionByName(new.select(*old.columns)), keys, version, tiebreak)


def latest_per_key(df: DataFrame, keys: list[str], version: str = "version", tiebreak: str | None = None) -> DataFrame:
    """A store built from scratch: the last row per key."""
    cols = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), _order(version, tiebreak)).alias("_last"))
    return agg.select(*keys, *[F.col("_last." + c).alias(c) for c in cols])


# S7
def rows_for_table(spark, path: str, cols: list[str]) -> DataFrame:
    """Named columns of a stored table (the projection reaches the scan)."""
    return spark.read.parquet(path).select(*cols)


def first_per_key(df: DataFrame, keys: list[str], version: str = "version", tiebreak: str | None = None) -> DataFrame:
    cols = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.min_by(F.struct(*cols), _order(version, tiebreak)).alias("_first"))
    return agg.select(*keys, *[F.col("_first." + c).alias(c) for c in cols])


# K7
def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str], version: str = "version",
                     tiebreak: str | None = None) -> DataFrame:
    """Rows of ``new`` whose key is not in ``old`` (first new row per key), added to old."""
    fresh = first_per_key(new.select(*old.columns), keys, version, tiebreak).join(old.select(*keys), keys, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


# S6
def decode_json_array(content, schema: str) -> "F.Column":
    """JSON text -> typed array; empty or missing text -> empty array."""
    c = F.when(F.col(content).isNull() | (F.trim(F.col(content)) == ""), F.lit("[]")).otherwise(F.col(content))
    return F.coalesce(F.from_json(c, f"array<{schema}>"), F.expr(f"cast(array() as array<{schema}>)"))


# J9 / A14
def to_json_list(*cols) -> "F.Column":
    """One-element JSON list of a record (the store's content format)."""
    return F.to_json(F.array(F.struct(*cols)))


# S5
def content_per_source(docs: DataFrame, key: str = "term", source: str = "source") -> DataFrame:
    """Long form (term, source, n_docs, n_chars): every source a term has content in."""
    return docs.groupBy(key, source).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text")).alias("n_chars"))


# S14
def read_sharded_dump(dump: DataFrame, col: str = "value", inner_schema: str = "struct<term:string,definition:string>"):
    """``{"shard": {"term": "<json list>"}}`` text -> (shard, term, item...) rows."""
    m = F.from_json(F.col(col), "map<string,map<string,string>>")
    s = dump.select(F.explode(m).alias("shard", "_terms"))
    t = s.select("shard", F.explode("_terms").alias("term", "_json"))
    return t.select("shard", "term", F.explode_outer(decode_json_array("_json", inner_schema)).alias("item"))
