"""Importance resampling towards a target distribution, with hashed word-run features.

Features of a text are its runs of 1 to ``max_run`` consecutive words (A-Z lower-cased, words are
runs of digits, letters and bytes above 127), joined by one space; a feature's bucket is the
unsigned CRC-32 of its UTF-8 bytes modulo ``buckets``. The two feature histograms (all documents,
all target texts) give every bucket a gain, the floored log ratio of smoothed frequencies in
thousandths; a document's weight is the floored mean gain of its features. Adding Gumbel noise
from a hash of the document's id makes the highest scores a weighted sample without replacement.

CRC-32 is affine over GF(2): the CRC of a span is the XOR of one contribution for each byte, which
depends on the byte and its distance from the span's end only, and of a constant for the span's
length. ``Crc`` holds the contributions in a table (``REACH`` distances x 256 bytes); a block of
spans is hashed by one gather and one ``bitwise_xor.reduceat``. Longer spans are cut into pieces of
``REACH`` bytes counted from their end, and neighbouring pieces fold pairwise: the left one is
moved on by a power of two times ``REACH`` zero bytes, a linear map kept as four byte tables.

Spark reads the documents twice: once for the histogram (each task sends at most ``buckets`` rows)
and once for the weights. The gain table (``buckets`` numbers) is the only thing that passes
through the driver. Ranks come from the counts of the different scores and a row number inside each
score, so no task holds all drawn rows.

Defined results: null or wordless texts have no feature, weight 0; a null id hashes as an empty id;
repeated rows are scored and drawn one by one, equal scores by id (null first), equal ids in any
order; an empty table gives an empty result, and an empty target table a histogram of zeros. A text
of any length is hashed whole: its bytes are read once, and index arrays cover ``BLOCK`` bytes of
spans at a time. Input columns named like an output column, in any case, give way to it."""
from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, checked_broadcast, materialise

REACH = 64  # distances from the end in the position table
SLICE = 4 << 20  # bytes of whole texts handled together
BLOCK = 1 << 20  # bytes of spans hashed together


def _byte_tables(images: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by the images of its bits, as four tables of 256."""
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    return np.stack([np.bitwise_xor.reduce(np.where(bits, images[8 * k: 8 * k + 8], 0), axis=1) for k in range(4)]).astype(np.uint32)


class Crc:
    """CRC-32 of many spans of one byte array."""

    def __init__(self) -> None:
        zero = zlib.crc32(b"\0")
        step = np.array([zlib.crc32(bytes([b])) ^ zero for b in range(256)], np.uint32)
        table = np.empty((REACH, 256), np.uint32)
        table[0] = step
        for d in range(1, REACH):
            table[d] = (table[d - 1] >> 8) ^ step[table[d - 1] & 255]
        self.table = table.ravel()
        self.lengths = np.array([zlib.crc32(bytes(n)) for n in range(REACH + 1)], np.uint32)
        one = np.uint32(1) << np.arange(32, dtype=np.uint32)
        self._moves = [_byte_tables((one >> 8) ^ step[one & 255])]

    def move(self, values: np.ndarray, power: int) -> np.ndarray:
        """Register values after 2**power zero bytes."""
        while len(self._moves) <= power:
            last, one = self._moves[-1], np.uint32(1) << np.arange(32, dtype=np.uint32)
            self._moves.append(_byte_tables(_apply(last, _apply(last, one))))
        return _apply(self._moves[power], values)

    def length_constants(self, sizes: np.ndarray) -> np.ndarray:
        """CRC of as many zero bytes."""
        out = np.full(len(sizes), 0xFFFFFFFF, np.uint32)
        for power in range(int(sizes.max(initial=0)).bit_length()):
            out = np.where((sizes >> power) & 1, self.move(out, power), out)
        return out ^ np.uint32(0xFFFFFFFF)

    def _pieces(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """XOR of the contributions of each span of at most REACH bytes."""
        size = end - start
        first = np.cumsum(size) - size
        at = np.arange(int(size.sum())) - np.repeat(first - start, size)
        key = np.repeat(end - 1, size) - at
        return np.bitwise_xor.reduceat(self.table[(key << 8) | data[at]], first)

    def spans(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """CRC-32 of data[start:end] of each span; no span is empty."""
        size = end - start
        if not len(size):
            return np.empty(0, np.uint32)
        if size.max() <= REACH:
            return self._pieces(data, start, end) ^ self.lengths[size]
        count = -(-size // REACH)
        owner = np.repeat(np.arange(len(size)), count)
        back = np.repeat(np.cumsum(count), count) - 1 - np.arange(len(owner))  # pieces to the right of this one
        stop = end[owner] - back * REACH
        value = np.empty(len(owner), np.uint32)
        pieces = np.maximum(start[owner], stop - REACH)
        for lo in range(0, len(owner), BLOCK // REACH):
            cut = slice(lo, lo + BLOCK // REACH)
            value[cut] = self._pieces(data, pieces[cut], stop[cut])
        power = REACH.bit_length() - 1
        while back.any():
            value = np.where(back & 1, self.move(value, power), value)
            pair = back >> 1
            head = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1])])
            value, back, owner, power = np.bitwise_xor.reduceat(value, head), pair[head], owner[head], power + 1
        return value ^ self.length_constants(size)


def _apply(tables: np.ndarray, values: np.ndarray) -> np.ndarray:
    return tables[0][values & 255] ^ tables[1][(values >> 8) & 255] ^ tables[2][(values >> 16) & 255] ^ tables[3][values >> 24]


@cache
def _shared() -> tuple[Crc, np.ndarray, np.ndarray]:
    """The hash tables, the lower-cased byte and whether a byte belongs to a word."""
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    word = np.zeros(256, bool)
    word[48:58] = word[97:123] = word[128:] = True
    return Crc(), low, word


def feature_blocks(texts: pa.Array, max_run: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of the text, bucket) of every feature, in blocks of a bounded number of bytes."""
    crc, low, is_word = _shared()
    line_end, nothing = pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())
    ended = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_string()), ""), line_end, nothing)  # no word runs into the next text
    offsets = np.frombuffer(ended.buffers()[1], np.int64)[ended.offset: ended.offset + len(ended) + 1]
    raw = np.frombuffer(ended.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(ended):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        data = low[raw[offsets[at]: offsets[to]]]
        inside = is_word[data]
        keep = inside.copy()
        keep[1:] |= inside[:-1]  # the byte after a word becomes the space that joins it to the next
        edge = np.diff(inside.view(np.int8), prepend=0)
        begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        text = np.searchsorted(offsets[at + 1: to + 1] - offsets[at], begin, "right") + at
        data[~inside] = 32
        data = data[keep]
        stop = np.cumsum(stop - begin + 1) - 1
        begin = np.r_[0, stop[:-1] + 1] if len(stop) else stop
        for run in range(1, max_run + 1):
            n = len(begin) - run + 1
            if n <= 0:
                break
            same = np.flatnonzero(text[:n] == text[run - 1:]) if run > 1 else np.arange(n)
            starts, ends = begin[same], stop[same + run - 1]
            total = np.cumsum(ends - starts)
            lo = 0
            while lo < len(same):
                base = total[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(total, base + BLOCK, "right")))
                yield text[same[lo:hi]], crc.spans(data, starts[lo:hi], ends[lo:hi]) % np.uint32(buckets)
                lo = hi
        at = to


def feature_counts(texts: DataFrame, text: str, max_run: int, buckets: int) -> DataFrame:
    """(bucket, n) over all texts; a task sends one row for each bucket that it meets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, found in feature_blocks(batch.column(0), max_run, buckets):
                total += np.bincount(found, minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], ["bucket", "n"])

    return texts.select(texts[text].cast("string")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """Floored thousandths of the log ratio of smoothed target to source frequencies."""
    s_all, t_all = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1.0) * s_all / ((source.get(b, 0) + 1.0) * t_all))) for b in range(buckets)], np.int64)


def with_weights(docs: DataFrame, text: str, rest: list[Column], gains: np.ndarray, max_run: int) -> DataFrame:
    """``rest`` as struct column _row, with n_words, n_features and weight."""
    buckets = len(gains)
    rows = docs.select(F.struct(F.lit(0).alias("_"), *rest).alias("_row"), docs[text].cast("string").alias("_text"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, total, words = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for owner, found in feature_blocks(batch.column(1), max_run, buckets):
                head = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                own = owner[head]
                n[own] += np.diff(np.r_[head, len(owner)])
                total[own] += np.add.reduceat(gains[found], head)
            if max_run > 1:
                for owner, _ in feature_blocks(batch.column(1), 1, buckets):
                    words += np.bincount(owner, minlength=len(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in (n if max_run == 1 else words, n, total // np.maximum(n, 1)))],
                                             ["_row", "n_words", "n_features", "weight"])

    schema = T.StructType([rows.schema["_row"], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight"))])
    return rows.mapInArrow(weigh, schema)


def noisy_score(key: Column, weight: Column, seed: int) -> Column:
    """Weight plus thousandths of Gumbel noise from the hash of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    unit = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return weight + F.floor(F.lit(-1000.0) * F.ln(-F.ln(unit))).cast("long")


def _positions_before(scores: DataFrame) -> DataFrame:
    """(_at, _before: drawable rows of higher scores), by sums over ranges of scores and inside each range."""
    counts = materialise(scores.groupBy(F.col("score").alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
                         .withColumn("_range", F.shiftright("_at", 10)), "scores")
    ranges = counts.groupBy("_range").agg(F.sum("_n").alias("_sum"))
    above = ranges.select(F.col("_range").alias("_r"), (F.sum("_sum").over(Window.orderBy(F.desc("_range"))) - F.col("_sum")).alias("_above"))
    inside = F.sum("_n").over(Window.partitionBy("_range").orderBy(F.desc("_at"))) - F.col("_n")
    return counts.withColumn("_inside", inside).join(checked_broadcast(above), F.col("_range") == F.col("_r")).select(
        "_at", (F.col("_inside") + F.col("_above")).alias("_before"), "_n")


def resample(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", key: str = "doc_id", carry: list[str] | None = None,
             max_run: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """Rows of ``docs`` (columns ``carry``, default all) with n_words, n_features, weight, score and rank (null: not drawn).

    Drawn are the highest scores, ``percent`` of the documents with at least ``least_words`` words."""
    source_n, target_n = ({r[0]: r[1] for r in feature_counts(x, c, max_run, buckets).collect()} for x, c in ((docs, text), (target, target_text)))
    gains = bucket_gains(source_n, target_n, buckets)
    names, rest = carried(docs, carry, ["n_words", "n_features", "weight", "score", "rank"])
    weighed = with_weights(docs, text, [*rest, docs[key].alias("_key")], gains, max_run)
    scored = materialise(weighed.withColumn("score", noisy_score(F.col("_row._key"), F.col("weight"), seed)), "scored")
    can = F.col("n_words") >= least_words
    before = materialise(_positions_before(scored.filter(can)), "positions")
    n_drawn = (before.agg(F.sum("_n")).first()[0] or 0) * percent // 100
    placed = scored.join(checked_broadcast(before.drop("_n")), can & (F.col("score") == F.col("_at")), "left")
    near = F.coalesce(F.col("_before") < n_drawn, F.lit(False))  # scores of which at least one row is drawn
    row = F.row_number().over(Window.partitionBy("score").orderBy(F.col("_row._key").asc_nulls_first())) + F.col("_before")
    drawn = placed.filter(near).withColumn("rank", F.when(row <= n_drawn, row).cast("long"))
    out = drawn.unionByName(placed.filter(~near).withColumn("rank", F.lit(None).cast("long")))
    return out.select(*[F.col("_row").getField(f"c{i}").alias(c) for i, c in enumerate(names)], "n_words", "n_features", "weight", "score", "rank")
