"""Exact duplicates through an extendible-hash index on shared files.

Keys are 64-bit hashes of the whole text; a bucket is a prefix of the key, so
buckets are key ranges. The directory starts with one bucket and depth 0. A
bucket whose texts exceed the page size is split by its next bit; when its
local depth equals the directory's, the directory doubles. The load per
prefix comes from one aggregation over all keys (a copy of a text counts
once), so the directory is final before texts move.

Each map task first folds equal texts of a batch into one entry (largest id,
number of rows), so a text that fills a third of the table moves once per
batch. Owner tasks then take contiguous bucket ranges and read them in key
order. Entries under one key form a chain: their texts are compared byte by
byte, and each different text is a link of its own (a hash collision costs a
link, never a wrong match). An owner holds the texts of one key at a time. The
index (bucket, key, chain position, SHA-256, id that stays, group size) is
written to the shared folder and documents look themselves up in it.

Defined results: a null text counts as empty; of equal texts the largest id
stays (null ids are smaller than any); rows that repeat id and text as well
count in the group and one of them stays; an empty table gives an empty
result; input columns of the same name as an output column are replaced.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, materialise, text_or_empty

PAGE_BYTES = 32 << 20  # texts of a bucket before it splits
MAX_DEPTH = 20  # largest directory: 2**20 entries; deeper buckets stay overfull and their owner reads on


def build_directory(loads: dict[int, int], depth_limit: int, page: int) -> list[tuple[int, int, int]]:
    """Buckets (first prefix, one past the last prefix, local depth) in key order, for loads by prefix of ``depth_limit`` bits."""
    running = [0]
    for prefix in range(1 << depth_limit):
        running.append(running[-1] + loads.get(prefix, 0))
    depth, buckets, open_ = 0, [], [(0, 0)]
    while open_:
        local, prefix = open_.pop()
        width = 1 << (depth_limit - local)
        lo, hi = prefix * width, (prefix + 1) * width
        if running[hi] - running[lo] > page and local < depth_limit:
            depth = max(depth, local + 1)  # the directory doubles when a bucket outgrows it
            open_ += [(local + 1, 2 * prefix + 1), (local + 1, 2 * prefix)]
        else:
            buckets.append((lo, hi, local))
    return buckets


def assign_owners(buckets: list[tuple[int, int, int]], loads: dict[int, int], owners: int) -> list[int]:
    """Owner of each bucket: contiguous ranges of about equal load."""
    sums = [sum(loads.get(p, 0) for p in range(lo, hi)) for lo, hi, _ in buckets]
    total, seen, found = max(1, sum(sums)), 0, []
    for load in sums:
        found.append(min(owners - 1, seen * owners // total))
        seen += load
    return found


def _merge(entry: list, doc: int | None, n: int, best: int) -> None:
    """Add rows of an equal text to [id that stays, rows, rows with that id]."""
    if entry[0] == doc:
        entry[2] += best
    elif entry[0] is None or (doc is not None and doc > entry[0]):
        entry[0], entry[2] = doc, best
    entry[1] += n


def _batch(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal texts of a batch become one entry."""
    schema = pa.schema([("_h", pa.int64()), ("_text", pa.string()), ("_id", pa.int64()), ("_n", pa.int64()), ("_best", pa.int64())])
    for batch in batches:
        found: dict[str, tuple[int, list]] = {}
        for h, text, doc in zip(*(batch.column(c).to_pylist() for c in ("_h", "_text", "_id")), strict=True):
            if text in found:
                _merge(found[text][1], doc, 1, 1)
            else:
                found[text] = (h, [doc, 1, 1])
        yield from _batch([(h, text, *entry) for text, (h, entry) in found.items()], schema)


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Read a bucket range in key order; chain the different texts under each key."""
    schema = pa.schema([("_h", pa.int64()), ("chain", pa.int32()), ("text_sha256", pa.string()),
                        ("keep_id", pa.int64()), ("group_size", pa.int64()), ("_best", pa.int64())])
    key, chain = None, []

    def links() -> list[tuple]:
        return [(key, i, hashlib.sha256(text.encode()).hexdigest(), *entry) for i, (text, entry) in enumerate(chain)]

    for batch in batches:
        out = []
        for h, text, doc, n, best in zip(*(batch.column(c).to_pylist() for c in ("_h", "_text", "_id", "_n", "_best")), strict=True):
            if h != key:
                out += links()
                key, chain = h, []
            for other, entry in chain:
                if other == text:  # byte comparison
                    _merge(entry, doc, n, best)
                    break
            else:
                chain.append((text, [doc, n, best]))
        yield from _batch(out, schema)
    yield from _batch(links(), schema)


def build_index(docs: DataFrame, text: str = "text", key: str = "doc_id", page: int = PAGE_BYTES) -> DataFrame:
    """The index over all rows: one entry per different text, written to the shared folder."""
    spark = docs.sparkSession
    rows = docs.select(docs[key].cast("long").alias("_id"), text_or_empty(docs[text]).alias("_text"))
    rows = rows.withColumn("_h", F.xxhash64("_text"))
    sizes = rows.groupBy("_h").agg(F.max(F.octet_length("_text")).alias("_bytes"))
    cell = F.shiftrightunsigned(F.col("_h"), 64 - MAX_DEPTH)
    cells = materialise(sizes.groupBy(cell.alias("_cell")).agg(F.sum("_bytes").alias("_bytes")), "cells")
    total = cells.agg(F.sum("_bytes")).first()[0] or 0
    depth = min(MAX_DEPTH, max(1, (total // page + 1).bit_length() + 2))
    shift = MAX_DEPTH - depth
    loads = {r[0]: r[1] for r in cells.groupBy(F.shiftrightunsigned("_cell", shift)).agg(F.sum("_bytes")).collect()}
    buckets = build_directory(loads, depth, page)
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    owned = assign_owners(buckets, loads, owners)
    # The directory: one row for each prefix, 2**MAX_DEPTH at most.
    directory = spark.createDataFrame(
        [(p, b, o) for b, ((lo, hi, _), o) in enumerate(zip(buckets, owned, strict=True)) for p in range(lo, hi)],
        "_p long, bucket int, _owner int")
    prefix = F.shiftrightunsigned(F.col("_h"), 64 - depth)
    entries = rows.mapInArrow(_fold, "_h long, _text string, _id long, _n long, _best long")
    placed = entries.withColumn("_p", prefix).join(checked_broadcast(directory, 1 << MAX_DEPTH), "_p")
    mine = placed.repartitionById(owners, F.col("_owner")).sortWithinPartitions("_h")
    index = mine.select("_h", "_text", "_id", "_n", "_best").mapInArrow(
        _own, "_h long, chain int, text_sha256 string, keep_id long, group_size long, _best long")
    return materialise(index, "index")


def mark_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` (columns ``carry``, default all) with keep_id, group_size, kept and text_sha256."""
    mine = {"keep_id", "group_size", "kept", "text_sha256"}
    kept = [c for c in (docs.columns if carry is None else carry) if c not in mine]
    index = build_index(docs, text, key)
    whole = text_or_empty(docs[text])
    rows = docs.select(F.struct(*[docs[c] for c in kept]).alias("_row"), docs[key].cast("long").alias("_id"),
                       F.xxhash64(whole).alias("_h"), F.sha2(whole, 256).alias("text_sha256"))
    found = rows.join(index.drop("chain"), ["_h", "text_sha256"])
    kept_row = F.col("_id").eqNullSafe(F.col("keep_id"))
    if not index.filter("_best > 1").isEmpty():
        # Some rows repeat id and text; only such rows share a partition here.
        kept_row &= F.row_number().over(Window.partitionBy("_h", "text_sha256", "_id").orderBy("_id")) == 1
    return found.withColumn("kept", kept_row).select(
        *[F.col("_row").getField(c).alias(c) for c in kept], "keep_id", "group_size", "kept", "text_sha256")
