"""Positions of regex matches as column expressions (no Python on the rows).

A text is split at the matches; the lengths of the pieces between them and of
the matches give every match's place in code points. Prefix sums run in two
levels (blocks of ``BLOCK`` matches), so many matches in one text cost
matches x BLOCK, not matches squared."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda acc, x: acc + x)


def match_spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches; code points, end exclusive.

    The pattern must not match the empty string. Null text: empty."""
    kind = "array<struct<start:int,end:int,value:string>>"

    def place(x: Column) -> Column:
        gaps, hits = x["gaps"], x["hits"]
        widths = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.length(g) + F.length(h))

        def with_widths(y: Column) -> Column:
            w = y["w"]
            blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / BLOCK).cast("int")),
                                 lambda b: _sum(F.slice(w, b * BLOCK + 1, F.lit(BLOCK))))
            start = F.struct(F.array().cast("array<int>").alias("before"), F.lit(0).alias("sum"))
            before = F.aggregate(blocks, start, lambda acc, s: F.struct(
                F.concat(acc["before"], F.array(acc["sum"])).alias("before"), (acc["sum"] + s).alias("sum")))

            def with_blocks(z: Column) -> Column:
                def one(hit: Column, i: Column) -> Column:
                    b = F.floor(i / BLOCK).cast("int")
                    at = (F.get(z["before"], b) + _sum(F.slice(w, b * BLOCK + 1, i - b * BLOCK)) + F.length(F.get(gaps, i)))
                    return F.struct(at.cast("int").alias("start"), (at + F.length(hit)).cast("int").alias("end"), hit.alias("value"))

                return F.transform(hits, one)

            return let(before, with_blocks)

        return let(F.struct(widths.alias("w")), with_widths)

    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    none = F.array().cast(kind)
    return F.when(F.coalesce(text.rlike(pattern), F.lit(False)), let(found, place)).otherwise(none)


def tagged(spans: Column, kind: str, order: int) -> Column:
    """Spans with their kind and its place in the listing."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"),
                                                 F.lit(kind).alias("kind"), s["value"].alias("value")))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(spans: Column) -> Column:
    return F.sha2(joined(spans), 256)


def replaced(text: Column, spans: Column, by: Callable[[Column], Column]) -> Column:
    """Text with each span replaced by ``by(span)``; spans sorted by start, a span inside an earlier one is skipped."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), by(s))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(more.alias("out"), s["end"].alias("at")))

    done = F.aggregate(spans, start, step)
    return let(done, lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text))))
