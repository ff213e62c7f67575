"""Keyed credit / back-off fold (W5) over an ordered ok/fail event table.

Per key, rounds are processed in order with state (credit, waiting, available):
* waiting > 0: waiting - 1, the round is skipped (no check);
* ok: credit - 1 (not below 0), available;
* fail: credit + 1, waiting = min(cap, waiting + credit), unavailable.

The fold is sequential per key, so it cannot be split inside a key. It is run
as a stream over each partition: rows are hash-partitioned by key and sorted
by (key, order) inside partitions, and ``mapInPandas`` walks the Arrow batches
carrying only the current key's three numbers. A hot key is streamed through
one task in bounded memory; it is never collected into one group.
"""
from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: longest back-off in rounds.
WAIT_CAP = 100
STATE_FIELDS = "skipped boolean, credit int, waiting int, available boolean"


def step(credit: int, waiting: int, available: bool, ok: bool, cap: int = WAIT_CAP):
    """One round; returns (credit, waiting, available, skipped)."""
    if waiting > 0:
        return credit, waiting - 1, available, True
    if ok:
        return max(0, credit - 1), waiting, True, False
    credit += 1
    return credit, min(cap, waiting + credit), False, False


def fold_frame(pdf: pd.DataFrame, key: str, ok: str, start: dict | None = None, cap: int = WAIT_CAP):
    """Fold one pandas frame sorted by (key, order). ``start`` maps key -> state
    to continue from (streaming); returns (frame with state columns, last states)."""
    n = len(pdf)
    keys = pdf[key].to_numpy()
    oks = pdf[ok].to_numpy()
    skipped = np.zeros(n, dtype=bool)
    credit = np.zeros(n, dtype=np.int32)
    waiting = np.zeros(n, dtype=np.int32)
    avail = np.zeros(n, dtype=bool)
    last: dict = dict(start or {})
    cur, c, w, a = object(), 0, 0, False
    for i in range(n):
        k = keys[i]
        if k != cur:
            cur = k
            c, w, a = last.get(k, (0, 0, False))
        c, w, a, s = step(c, w, a, bool(oks[i]), cap)
        skipped[i], credit[i], waiting[i], avail[i] = s, c, w, a
        last[k] = (c, w, a)
    out = pdf.assign(skipped=skipped, credit=credit, waiting=waiting, available=avail)
    return out, last


def credit_fold(events: DataFrame, key: str, order: list[str], ok, partitions: int | None = None,
                cap: int = WAIT_CAP) -> DataFrame:
    """Per-event state after each round, for every key (batch form of W5)."""
    ok_col = ok if isinstance(ok, str) else "_ok"
    df = events if isinstance(ok, str) else events.withColumn("_ok", ok)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartition(n, key).sortWithinPartitions(key, *order)
    schema = T.StructType(ordered.schema.fields + [
        T.StructField("skipped", T.BooleanType()), T.StructField("credit", T.IntegerType()),
        T.StructField("waiting", T.IntegerType()), T.StructField("available", T.BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry: dict = {}
        for pdf in batches:
            out, last = fold_frame(pdf, key, ok_col, carry, cap)
            # only the last key of a batch can continue into the next batch
            carry = {pdf[key].iloc[-1]: last[pdf[key].iloc[-1]]} if len(pdf) else carry
            yield out

    return ordered.mapInPandas(run, schema)


def final_states(folded: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Last state per key (max_by on the order, a normal aggregate)."""
    o = F.struct(*order)
    return folded.groupBy(key).agg(*[F.max_by(c, o).alias(c) for c in ("credit", "waiting", "available")])
