"""Keyed credit / back-off state over an event stream.

``applyInPandasWithState`` keeps (credit, waiting, available) per key between
micro-batches; inside a batch the key's rows are folded in event order with
the same step function as the batch operator (``operators.state``).
"""
from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.state import WAIT_CAP, fold_frame

STATE_SCHEMA = T.StructType([T.StructField("credit", T.IntegerType()), T.StructField("waiting", T.IntegerType()),
                             T.StructField("available", T.BooleanType())])


def credit_stream(events: DataFrame, key: str, order: list[str], ok: str, cap: int = WAIT_CAP) -> DataFrame:
    """Per-event state rows (append mode); events of a key must arrive in order
    across micro-batches (e.g. a watermark-ordered source)."""
    out_schema = T.StructType(events.schema.fields + [
        T.StructField("skipped", T.BooleanType()), T.StructField("credit", T.IntegerType()),
        T.StructField("waiting", T.IntegerType()), T.StructField("available", T.BooleanType())])

    def fn(k, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(order, kind="stable")
        start = {}
        if state.exists:
            c, w, a = state.get
            start = {k[0]: (int(c), int(w), bool(a))}
        out, last = fold_frame(pdf, key, ok, start, cap)
        c, w, a = last[k[0]]
        state.update((int(c), int(w), bool(a)))
        yield out

    return events.groupBy(key).applyInPandasWithState(fn, out_schema, STATE_SCHEMA, "append",
                                                      GroupStateTimeout.NoTimeout)
