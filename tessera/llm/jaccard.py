"""N-gram Jaccard join with prefix filters under several global token orders.

A document's tokens are the 64-bit hashes of its distinct word n-grams. Two
sets of Jaccard similarity t or more share a token among the first
n - ceil(t n) + 1 of each, under any order of all tokens; more exactly they
share at least p - (n - overlap) of them. Candidates must pass this filter
under ``ORDERS`` different orders before their whole sets are compared:

* each order puts rare tokens first, by counts over all documents in 2**22
  hashed counters (a bounded table; a collision only moves a token back), and
  ties by a hash of its own;
* the first order's prefix tokens are posting lists, joined by token; a pair
  counts where the token's places allow it to be the first that both share;
* the other orders' prefixes are intersected for the pairs that remain, and
  must share as many tokens as the bound asks.

No group is paired with itself as a whole. Documents with equal sets form one
class first. Then, in the lists of ``STAR`` classes or more, every class is
only compared with about ``HEADS`` of them, in a few rounds, and the links
found give first components. Lists that lie in one component are done; the
others yield their pairs across components. So every pair of classes that may be similar is
either compared or already connected, and components are exact.

Pairs across components are mostly of sets that are not similar, and in a large
group of them there are many. So a pair must first pass a bound on parity
sketches, where it is formed: a set's tokens each flip one of ``SKETCH`` * 64
bits, so two sketches differ in no more bits than the sets have tokens apart,
and similar sets have few of these. The bound drops no similar pair.

The links themselves are another output (``similar_sets``, ``link_counts``):
every pair of classes that passes the filters is compared, whether connected
or not. There a list longer than ``WIDE`` is met by pairs of blocks of its
classes, so that no task pairs a whole list. Rows of equal sets are one class;
``link_counts`` gives each row its class, so their links follow from it.

Defined results: lower case is of A-Z only; null text and text without words
have an empty set and are linked with nothing (their component is their own
id); a text of fewer words than n has one token, the whole sequence; repeated
rows are in one class; a component without any id has a null id; an empty
table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frees_memory, materialise, text_or_empty
from .components import components, extended

COUNTERS = 22  # bits: 4M counters
BLOCKS = 64
ORDERS = 3
STAR = 16  # classes of a posting list from which it is long: first compared with a few of its classes only
SKETCH = 8  # 64-bit words of the parity sketch of a set
HEADS = 12  # classes of a long list that the others are compared with in a star round
ROUNDS = 3  # star rounds, each with other heads
WIDE = 512  # classes of a posting list, about, that one task pairs when all links are asked
BLOOM = 27  # 2**27 bits at most in the filter that picks the documents whose whole sets are needed
BLOOM_BLOCK = 6  # it is made in 2**6 blocks

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 16, 1 << n.bit_length())
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(size - 1, b)]), dtype=np.uint64)
                      for b in (np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64)))]
    return _POWERS[0], _POWERS[1]


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct tokens of a text."""
    raw = np.frombuffer(text.encode().lower(), dtype=np.uint8)  # bytes.lower changes A-Z only
    inside = np.concatenate([[False], ~_SPACE[raw], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers(len(raw) + 1)
    # The sum of byte values times powers, shifted back to the word's start.
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[raw] * up[:len(raw)], dtype=np.uint64)])
    word = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _M2)
    k = min(width, len(word))
    n = len(word) - k + 1
    token = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        token = mix(token * np.uint64(_BASE) + word[i:i + n])
    return np.unique(token)


def class_of(tokens: np.ndarray) -> int:
    """A 64-bit fingerprint of a set."""
    total = mix(tokens + np.uint64(len(tokens))).sum(dtype=np.uint64, keepdims=True)
    return int(mix(total)[0].astype(np.int64))


def _mark(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bits of each block's keys."""
        blocks: dict[int, np.ndarray] = {}
        low = bits - BLOOM_BLOCK
        for batch in batches:
            name = batch.column("_key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            cell = (name << np.uint64(BLOOM_BLOCK)) >> np.uint64(64 - low)
            block = batch.column("_block").to_numpy(zero_copy_only=False)
            for b in np.unique(block):
                have = blocks.setdefault(int(b), np.zeros(1 << (low - 3), dtype=np.uint8))
                some = cell[block == b]
                np.bitwise_or.at(have, (some >> np.uint64(3)).astype(np.int64), (1 << (some & np.uint64(7)).astype(np.int64)).astype(np.uint8))
        if blocks:
            yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([b.tobytes() for b in blocks.values()], pa.binary())], ["_block", "_bits"])
    return run


def _texts(batch: pa.RecordBatch) -> list[str]:
    return batch.column("_text").to_pylist()


MEMBER_SCHEMA = "_id long, _key long, _class long, _n int, _block int, _counts binary"


def _scan(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, class, set size) of each row, and the partition's token counts by block."""
        counts = np.zeros(1 << COUNTERS, dtype=np.uint32)
        schema = pa.schema([("_id", pa.int64()), ("_key", pa.int64()), ("_class", pa.int64()), ("_n", pa.int32()), ("_block", pa.int32()), ("_counts", pa.binary())])
        some = False
        for batch in batches:
            classes, sizes, waiting, held = [], [], [], 0
            for text in _texts(batch):
                tokens = shingles(text, width)
                classes.append(class_of(tokens))
                sizes.append(len(tokens))
                waiting.append(tokens >> np.uint64(64 - COUNTERS))
                held += len(tokens)
                if held > 1 << 21:
                    counts += np.bincount(np.concatenate(waiting).astype(np.int64), minlength=1 << COUNTERS).astype(np.uint32)
                    waiting, held = [], 0
            if held:
                counts += np.bincount(np.concatenate(waiting).astype(np.int64), minlength=1 << COUNTERS).astype(np.uint32)
            some = some or bool(sizes)
            none = pa.nulls(len(sizes))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_key"), pa.array(classes, pa.int64()), pa.array(sizes, pa.int32()),
                                              none.cast(pa.int32()), none.cast(pa.binary())], schema=schema)
        if some:
            part = np.minimum(counts, 65535).astype("<u2").reshape(BLOCKS, -1)
            none = pa.nulls(BLOCKS)
            yield pa.RecordBatch.from_arrays([*[none.cast(pa.int64())] * 3, none.cast(pa.int32()), pa.array(range(BLOCKS), pa.int32()),
                                              pa.array([p.tobytes() for p in part], pa.binary())], schema=schema)
    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the count arrays of each block that the partition holds (at most ``BLOCKS``), and their totals."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, raw in zip(batch.column("_block").to_pylist(), batch.column("_counts").to_pylist(), strict=True):
            sums[b] = sums.get(b, 0) + np.frombuffer(raw, dtype="<u2").astype(np.int64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.astype("<i8").tobytes() for s in sums.values()], pa.binary()),
                                          pa.array([int(s.sum()) for s in sums.values()], pa.int64())], ["_block", "_counts", "_total"])


def _level(usual: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Half-logarithmic levels of the counts of each block."""
        for batch in batches:
            counts = [np.frombuffer(raw, dtype="<i8") for raw in batch.column("_counts").to_pylist()]
            some = [np.floor(2 * np.log2(np.maximum(c / usual, 1.0))).astype(np.uint8).tobytes() for c in counts]
            yield pa.RecordBatch.from_arrays([batch.column("_block"), pa.array(some, pa.binary())], ["_block", "_levels"])
    return run


def levels(scanned: DataFrame) -> np.ndarray:
    """Half-logarithmic frequency level of each counter, one byte each: 4 MB for any corpus, and the driver receives no more."""
    parts = scanned.filter(F.col("_block").isNotNull()).select("_block", "_counts")
    sums = materialise(parts.repartition(BLOCKS, "_block").mapInArrow(frees_memory(_add), "_block int, _counts binary, _total long"), "counts")
    usual = max(1.0, (sums.agg(F.sum("_total")).first()[0] or 0) / (1 << COUNTERS))
    out = np.zeros((BLOCKS, (1 << COUNTERS) // BLOCKS), dtype=np.uint8)
    for r in sums.select("_block", "_counts").mapInArrow(frees_memory(_level(usual)), "_block int, _levels binary").collect():
        out[r["_block"]] = np.frombuffer(r["_levels"], dtype=np.uint8)
    return out.reshape(-1)


def at_least(n: np.ndarray | int, percent: int):
    """Smallest overlap with any similar partner: ceil(percent * n / 100)."""
    return -(-percent * n // 100)


def prefix(tokens: np.ndarray, level: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The first n - ceil(t n) + 1 tokens in the order of (level, hash number ``order``)."""
    p = len(tokens) - int(at_least(len(tokens), percent)) + 1
    place = mix(tokens ^ np.uint64(_BASE * (order + 1) % (1 << 64)))
    key = (level[(tokens >> np.uint64(64 - COUNTERS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (place >> np.uint64(8))
    some = np.argpartition(key, p - 1)[:p] if p < len(tokens) else np.arange(len(tokens))
    return tokens[some[np.argsort(key[some])]]


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parity of the number of a set's tokens at each bit, as ``SKETCH`` 64-bit integers."""
    bit = (mix(tokens ^ np.uint64(_M2)) >> np.uint64(32)).astype(np.int64) % (64 * SKETCH)
    return np.packbits((np.bincount(bit, minlength=64 * SKETCH) & 1).astype(np.uint8)).view("<i8")


def _overlap_bound(na: Column, nb: Column, percent: int) -> Column:
    """Smallest overlap of a similar pair: ceil(percent (na + nb) / (100 + percent))."""
    return F.ceil(F.lit(percent) * (na + nb) / F.lit(100 + percent) - 1e-9).cast("int")


def _least_shared(na: Column, nb: Column, percent: int) -> Column:
    """Prefix tokens that a similar pair shares at least: min over both of p - (n - overlap)."""
    o = _overlap_bound(na, nb, percent)
    bound = lambda n: o - F.ceil(F.lit(percent) * n / 100 - 1e-9).cast("int") + 1
    return F.greatest(F.lit(1), F.least(bound(na), bound(nb)))


def _similar_sizes(percent: int) -> str:
    return f"100 * least(na, nb) >= {percent} * greatest(na, nb)"


def _first_places(percent: int) -> Column:
    """Whether a token at the places ia and ib can be the first that a similar pair shares."""
    o = _overlap_bound(F.col("na"), F.col("nb"), percent)
    return (F.col("ia") <= F.col("na") - o) & (F.col("ib") <= F.col("nb") - o)


def _sketches_near(percent: int) -> Column:
    """Whether the sketches sa and sb differ in no more bits than the token sets of a similar pair may."""
    apart = F.lit(0)
    for i in range(SKETCH):
        apart = apart + F.bit_count(F.col(f"sa.s{i}").bitwiseXOR(F.col(f"sb.s{i}")))
    return apart <= F.col("na") + F.col("nb") - 2 * _overlap_bound(F.col("na"), F.col("nb"), percent)


class Join:
    """The join's tables for one run."""

    def __init__(self, docs: DataFrame, text: str, key: str, width: int, percent: int):
        self.spark, self.percent, self.width = docs.sparkSession, percent, width
        whole = text_or_empty(docs[text])
        self.rows = docs.select(docs[key].cast("long").alias("_id"), F.xxhash64(whole).alias("_key"), whole.alias("_text"))
        self.scanned = materialise(self.rows.mapInArrow(frees_memory(_scan(width)), MEMBER_SCHEMA), "scanned")
        self.members = self.scanned.filter(F.col("_n").isNotNull()).select("_id", "_key", "_class", "_n")
        self.level = self.spark.sparkContext.broadcast(levels(self.scanned))
        self.classes = self._prefixes()

    def _prefixes(self) -> DataFrame:
        """One row for each different set: _class, _n, its prefixes (the first as 64-bit tokens, the others as 32-bit hashes) and its sketch."""
        level, width, percent = self.level, self.width, self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple] = []
                seen = set()
                for text in _texts(batch):
                    tokens = shingles(text, width)
                    if not len(tokens):
                        continue
                    name = class_of(tokens)
                    if name not in seen:
                        seen.add(name)
                        first = prefix(tokens, level.value, 0, percent).astype(np.int64)
                        more = [(prefix(tokens, level.value, o, percent) >> np.uint64(32)).astype(np.uint32).astype(np.int32) for o in range(1, ORDERS)]
                        out.append((name, len(tokens), sketch(tokens), first, *more))
                if out:
                    cols = list(zip(*out, strict=True))
                    words = pa.StructArray.from_arrays([pa.array(w) for w in np.stack(cols[2], axis=1)], [f"s{i}" for i in range(SKETCH)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), words, pa.array(cols[3], pa.list_(pa.int64())),
                         *[pa.array(c, pa.list_(pa.int32())) for c in cols[4:]]], ["_class", "_n", "_sketch", "_p0", *[f"_p{o}" for o in range(1, ORDERS)]])

        more = "".join(f", _p{o} array<int>" for o in range(1, ORDERS))
        bits = ", ".join(f"s{i}: long" for i in range(SKETCH))
        each = self.rows.mapInArrow(frees_memory(run), f"_class long, _n int, _sketch struct<{bits}>, _p0 array<long>{more}")
        return materialise(each.dropDuplicates(["_class"]), "prefixes")

    def filtered(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) of the first order's filter that pass it under the other orders too, one order after the other."""
        for o in range(1, ORDERS):
            side = lambda s: self.classes.select(F.col("_class").alias(s), F.col("_n").alias(f"n{s}"), F.col(f"_p{o}").alias(f"p{s}"))  # noqa: B023, E731
            joined = pairs.join(side("a"), "a").join(side("b"), "b")
            need = _least_shared(F.col("na"), F.col("nb"), self.percent)
            pairs = materialise(joined.filter(F.size(F.array_intersect("pa", "pb")) >= need).select("a", "b"), "candidates")
        return pairs

    def compared(self, pairs: DataFrame) -> DataFrame:
        """(a, b, both: sum of the sizes, common) of the similar ones among candidate pairs, by their whole sets."""
        asked = materialise(pairs.select(F.col("a").alias("_class")).unionByName(pairs.select(F.col("b").alias("_class"))).distinct(), "asked")
        sets = self._sets(asked)
        side = lambda s: sets.select(F.col("_class").alias(s), F.col("_tokens").alias(f"t{s}"))
        joined = pairs.join(side("a"), "a").join(side("b"), "b")
        common = joined.select("a", "b", (F.size("ta") + F.size("tb")).alias("both"), F.size(F.array_intersect("ta", "tb")).alias("common"))
        return common.filter(F.col("common") * (100 + self.percent) >= F.col("both") * self.percent)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Links among candidate pairs."""
        return materialise(self.compared(pairs).select(F.col("a").alias("u"), F.col("b").alias("v")), "links")

    def _sets(self, asked: DataFrame) -> DataFrame:
        """(_class, _tokens) of the asked classes. A bit filter of bounded size on the texts' hashes picks
        the rows to read, at least one for each class; the join makes it exact."""
        width = self.width
        one = self.members.join(asked, "_class").groupBy("_class").agg(F.min("_key").alias("_key"))
        bits = min(BLOOM, max(BLOOM_BLOCK + 3, (16 * asked.count()).bit_length()))
        block = F.shiftrightunsigned("_key", 64 - BLOOM_BLOCK).cast("int")
        parts = one.select("_key", block.alias("_block")).repartition(1 << BLOOM_BLOCK, "_block").mapInArrow(frees_memory(_mark(bits)), "_block int, _bits binary")
        marks = np.zeros((1 << BLOOM_BLOCK, 1 << (bits - BLOOM_BLOCK - 3)), dtype=np.uint8)
        for r in parts.collect():  # 2**BLOOM bits at most
            marks[r["_block"]] = np.frombuffer(r["_bits"], dtype=np.uint8)
        marks = self.spark.sparkContext.broadcast(marks.reshape(-1))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = batch.column("_key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) >> np.uint64(64 - bits)
                hit = np.flatnonzero(marks.value[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8) & 1)
                seen: dict[int, np.ndarray] = {}
                for text in batch.column("_text").take(pa.array(hit)).to_pylist():
                    tokens = shingles(text, width)
                    if len(tokens):
                        seen[class_of(tokens)] = tokens.view(np.int64)
                if seen:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.list_(pa.int64()))], ["_class", "_tokens"])

        found = self.rows.mapInArrow(frees_memory(run), "_class long, _tokens array<long>")
        return materialise(found.join(asked, "_class", "left_semi").dropDuplicates(["_class"]), "sets")

    def postings(self) -> DataFrame:
        """(tok, at, c, n, df): the first order's prefix tokens that at least two classes share, and their places in it."""
        every = self.classes.select(F.posexplode("_p0").alias("at", "tok"), F.col("_class").alias("c"), F.col("_n").alias("n"))
        shared = every.groupBy("tok").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
        return materialise(every.join(shared, "tok"), "postings")

    def _pairs(self, left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
        """Pairs (a, b) of postings of a token, in different components, that may be similar; columns ``more`` of either side as {column}a and {column}b.

        The first token that similar sets share has at most n - overlap tokens
        before it in either set; later shared tokens need no entry."""
        a = left.select("tok", F.col("c").alias("a"), F.col("n").alias("na"), F.col("at").alias("ia"), F.col("label").alias("la"), *[F.col(c).alias(f"{c}a") for c in more])
        b = right.select("tok", F.col("c").alias("b"), F.col("n").alias("nb"), F.col("at").alias("ib"), F.col("label").alias("lb"), *[F.col(c).alias(f"{c}b") for c in more])
        return a.join(b, "tok").filter("la <> lb").filter(_similar_sizes(self.percent)).filter(_first_places(self.percent))

    def star(self, long: DataFrame, turn: int) -> DataFrame:
        """Candidate pairs of each class in a long list with about ``HEADS`` of its classes, drawn by a hash of this turn."""
        heads = long.filter(F.pmod(F.xxhash64(F.lit(turn), "c"), F.lit(1 << 20)) * F.col("df") < HEADS * (1 << 20))
        return self._pairs(long, heads).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def across(self, labelled: DataFrame) -> DataFrame:
        """Candidate pairs of classes that share prefix tokens and lie in different components."""
        rest = labelled.join(_mixed(labelled), "tok").join(self.classes.select(F.col("_class").alias("c"), F.col("_sketch").alias("s")), "c")
        return self._pairs(rest, rest, "s").filter("a < b").filter(_sketches_near(self.percent)).select("a", "b").distinct()

    def every(self, postings: DataFrame) -> DataFrame:
        """All candidate pairs of classes that share prefix tokens; long lists by pairs of blocks of their classes."""
        last = F.ceil(F.col("df") / WIDE).cast("int") - 1
        own = postings.withColumn("last", last).withColumn("block", F.pmod(F.xxhash64("c"), F.col("last") + 1).cast("int"))
        side = lambda s, lo, hi: own.select("tok", lo.alias("lo"), hi.alias("hi"), F.col("c").alias(s), F.col("n").alias(f"n{s}"), F.col("at").alias(f"i{s}"))
        low = side("a", F.col("block"), F.explode(F.sequence("block", "last")))
        high = side("b", F.explode(F.sequence(F.lit(0), "block")), F.col("block"))
        met = low.join(high, ["tok", "lo", "hi"]).filter("lo < hi OR a < b")
        return met.filter(_similar_sizes(self.percent)).filter(_first_places(self.percent)).select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def all_links(self) -> DataFrame:
        """(a, b, both, common) of every similar pair of classes, once each."""
        return materialise(self.compared(self.filtered(self.every(self.postings()))), "all_links")

    def components(self) -> DataFrame:
        """(node: class, component: smallest class that it reaches by links), exactly, of the classes with a link."""
        postings = self.postings()
        labelled = postings.withColumn("label", F.col("c"))
        known = None
        for turn in range(ROUNDS + 1):
            long = labelled.filter(F.col("df") >= STAR)
            if turn < ROUNDS and _mixed(long).isEmpty():
                continue  # every long list lies in one component already
            more = self.verified(self.filtered(self.star(long, turn) if turn < ROUNDS else self.across(labelled)))
            if known is not None and more.isEmpty():
                continue  # the components stay
            known = components(more) if known is None else extended(known, more)
            if turn < ROUNDS:
                labelled = materialise(postings.join(known.withColumnRenamed("node", "c"), "c", "left").select(
                    "tok", "at", "c", "n", "df", F.coalesce("component", "c").alias("label")), "labelled")
        return known


def _mixed(labelled: DataFrame) -> DataFrame:
    """Tokens whose lists lie in more than one component."""
    return labelled.groupBy("tok").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("tok")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """For each row: key, n_shingles (set size) and component_id (smallest id in its component)."""
    join = Join(docs, text, key, width, percent)
    comps = join.components().withColumnRenamed("node", "_class")
    some = join.members.filter("_n > 0").join(comps, "_class", "left").select("_id", "_n", F.coalesce("component", "_class").alias("_label"))
    least = some.groupBy("_label").agg(F.min("_id").alias("component_id"))
    out = some.join(least, "_label").select(F.col("_id").alias(key), F.col("_n").cast("long").alias("n_shingles"), "component_id")
    alone = join.members.filter("_n = 0").select(F.col("_id").alias(key), F.lit(0).cast("long").alias("n_shingles"), F.col("_id").alias("component_id"))
    return out.unionByName(alone)


def later_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """(key, text_hash: xxhash64 of the text) of all texts but the first of each component; first: the smallest id, nulls last, then the hash."""
    join = Join(docs, text, key, width, percent)
    comps = join.components().withColumnRenamed("node", "_class")
    rows = join.members.filter("_n > 0").join(comps, "_class", "left").select("_id", "_key", F.coalesce("component", "_class").alias("_label"))
    first = rows.groupBy("_label").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_key").alias("hash"))).alias("_first"))
    later = rows.join(first, "_label").filter(~(F.col("_id").eqNullSafe(F.col("_first.id")) & (F.col("_key") == F.col("_first.hash"))))
    return later.select(F.col("_id").alias(key), F.col("_key").alias("text_hash")).distinct()


def similar_sets(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """Every similar pair of different sets: a_set < b_set (fingerprints), a_id, b_id (smallest ids with the sets), n_common, n_union."""
    join = Join(docs, text, key, width, percent)
    name = lambda s: join.members.groupBy(F.col("_class").alias(s)).agg(F.min("_id").alias(f"{s}_id"))
    out = join.all_links().join(name("a"), "a").join(name("b"), "b")
    return out.select(F.col("a").alias("a_set"), F.col("b").alias("b_set"), "a_id", "b_id", F.col("common").cast("long").alias("n_common"),
                      (F.col("both") - F.col("common")).cast("long").alias("n_union"))


def link_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """For each row: key, set (fingerprint, as in ``similar_sets``), n_shingles, n_copies (other rows of an equal set)
    and n_links (other rows that it is linked with, copies included). Empty sets are linked with nothing."""
    join = Join(docs, text, key, width, percent)
    links = join.all_links().select("a", "b")
    sizes = join.members.filter("_n > 0").groupBy("_class").agg(F.count(F.lit(1)).alias("_rows"))
    ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = ways.join(sizes.withColumnRenamed("_class", "b"), "b").groupBy(F.col("a").alias("_class")).agg(F.sum("_rows").alias("_linked"))
    known = sizes.join(linked, "_class", "left").select("_class", (F.col("_rows") - 1).alias("n_copies"), (F.col("_rows") - 1 + F.coalesce("_linked", F.lit(0))).alias("n_links"))
    none = F.lit(0).cast("long")
    return join.members.join(known, "_class", "left").select(F.col("_id").alias(key), F.col("_class").alias("set"), F.col("_n").cast("long").alias("n_shingles"),
                                                             F.coalesce("n_copies", none).alias("n_copies"), F.coalesce("n_links", none).alias("n_links"))
