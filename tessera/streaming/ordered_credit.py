"""X2 with event-time order: the credit / back-off fold of ``operators.state`` on ``transformWithState``.

Per key the state store holds the fold's three numbers with the time of the last folded event (value
state) and the rows that wait for their turn (list state). Rows of a micro-batch are only added to
the waiting list, frame by frame; an event-time timer fires when the watermark passes them, and the rows
up to it are folded in order and leave. So rows may come late and in any order, within and across
micro-batches, as long as the watermark lets them in. A key that pauses longer than ``idle``
starts anew with its next event, and a timer drops its state once the watermark has passed the pause: state
is bounded by the keys seen in that time and the rows inside the watermark's delay.

Defined results: ties in time go by the other order columns; null times or keys are dropped by the
watermark; a row later than the watermark is dropped, as in any event-time operator; rows that no watermark
has passed yet wait in the state."""
from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.state import WAIT_CAP, step

FOLD = T.StructType([T.StructField("credit", T.IntegerType()), T.StructField("waiting", T.IntegerType()),
                     T.StructField("available", T.BooleanType()), T.StructField("last_ms", T.LongType())])
RESULT = [T.StructField("skipped", T.BooleanType()), T.StructField("credit", T.IntegerType()), T.StructField("waiting", T.IntegerType()), T.StructField("available", T.BooleanType())]


class OrderedCredit(StatefulProcessor):
    """Folds the waiting rows of a key up to the watermark."""

    def __init__(self, schema: T.StructType, time: str, order: list[str], ok: str, idle_ms: int | None, cap: int):
        self.schema, self.time, self.order, self.ok, self.idle_ms, self.cap = schema, time, order, ok, idle_ms, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fold = handle.getValueState("fold", FOLD)
        self.waiting = handle.getListState("waiting", self.schema)

    def _ms(self, row: tuple) -> int:
        return int(pd.Timestamp(row[self.schema.fieldNames().index(self.time)]).value // 1_000_000)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            held = [tuple(r) for r in frame[self.schema.fieldNames()].astype(object).itertuples(index=False)]
            self.waiting.appendList(held)
            times = [self._ms(r) for r in held]
            first = min([*times, *([] if first is None else [first])])
        if first is not None:
            self.handle.registerTimer(first + 1)  # a timer fires once the watermark has reached it
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        mark = int(timerValues.getCurrentWatermarkInMs())
        names = self.schema.fieldNames()
        held = [tuple(r) for r in self.waiting.get()]
        due = sorted((r for r in held if self._ms(r) < mark), key=lambda r: tuple(r[names.index(c)] for c in [self.time, *self.order]))
        rest = [r for r in held if self._ms(r) >= mark]
        c, w, a, last = self.fold.get() if self.fold.exists() else (0, 0, False, None)
        out = []
        for r in due:
            now = self._ms(r)
            if last is not None and self.idle_ms is not None and now - last > self.idle_ms:
                c, w, a = 0, 0, False
            c, w, a, skipped = step(int(c), int(w), bool(a), bool(r[names.index(self.ok)]), self.cap)
            last = now
            out.append((*r, skipped, c, w, a))
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
        if rest:
            self.handle.registerTimer(min(self._ms(r) for r in rest) + 1)
        if last is not None and self.idle_ms is not None and not rest and mark - last > self.idle_ms:
            self.fold.clear()  # the next event would start anew anyway
        elif last is not None and due:
            self.fold.update((int(c), int(w), bool(a), int(last)))
            if self.idle_ms is not None:
                self.handle.registerTimer(last + self.idle_ms + 1)
        if out:
            yield pd.DataFrame(out, columns=[*names, "skipped", "credit", "waiting", "available"])

    def close(self) -> None:
        pass


def ordered_credit_stream(events: DataFrame, key: str, time: str, order: list[str], ok: str, idle_seconds: int | None = None, cap: int = WAIT_CAP) -> DataFrame:
    """Per-event state rows in append mode; ``events`` has a watermark on ``time``, and the session the RocksDB state store.

    ``order`` breaks ties in time."""
    events = events.filter(F.col(key).isNotNull())
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in events.schema.fields])
    processor = OrderedCredit(schema, time, order, ok, None if idle_seconds is None else idle_seconds * 1000, cap)
    return events.groupBy(key).transformWithStateInPandas(processor, T.StructType([*schema.fields, *RESULT]), "Append", "eventtime")
