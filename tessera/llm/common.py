"""Helpers shared by the corpus operators: shared-folder tables, size-checked broadcasts, digests."""
from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Most rows of a lookup table that may be broadcast; beyond it the planner joins by shuffle (with skew splitting).
BROADCAST_ROWS = 100_000
# White space as the contracts define it: space and 09-0D.
WORD = "[^\\x20\\x09-\\x0D]+"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared checkpoint folder, removed when the driver's JVM ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tessera-{uuid.uuid4().hex[:12]}/{name}"
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path).getParent()
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only when ``df`` is seen to have at most ``rows`` rows; else the planner shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def carried(docs: DataFrame, carry: list[str] | None, mine: list[str]) -> tuple[list[str], list[Column]]:
    """Names of the input columns to keep, and those columns under private names c0, c1, ...

    Columns named like one of ``mine`` (in any case) give way to it; of columns that differ in case only the first stays."""
    taken, names, out = {m.lower() for m in mine}, [], []
    for c in docs.columns if carry is None else carry:
        if c.lower() not in taken:
            taken.add(c.lower())
            out.append(docs[f"`{c}`"].alias(f"c{len(names)}"))
            names.append(c)
    return names, out


def give_back_memory() -> None:
    """Return what a finished task has freed to the system: workers are reused, and idle ones count too."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def frees_memory(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's generator that gives its memory back at the end."""
    @wraps(run)
    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back_memory()
    return whole
