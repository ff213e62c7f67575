"""Mixing sources to target weights by Pareto order sampling (native DataFrame operations only).

Every source gets a target number of words: its weight's share of the total,
at most ``max_copies`` times its own words, what is above shared again by
weight. The whole part of target / words of a source is allocated with
certainty: so many copies of each of its documents. The rest, less than one
copy of the source, is an unequal-probability sample: a document of ``size`` words
is included with probability

    p = min(1, c * floor(sqrt(size)))

c being such that the expected words are the rest; documents with p = 1 are taken
for certain. The others are drawn by Pareto order sampling: a document with
random number U ranks by

    Q = (U / (1 - U)) / (p / (1 - p))

and the smallest Q are taken until the words that are left are reached, so the
sample has a fixed size in words. U is a hash of seed, id and text: reruns agree.

c comes from one small table (a row for each source and floor(sqrt(size))). The cut
in Q is found without sorting a source: two passes of 1,024-bucket histograms of
Q / (1 + Q) narrow it to a bucket of about a millionth of the unit interval, and
only that bucket is sorted.

Defined results: null text or a text without words has size 0 and takes 0
words; a null source is a source of its own, ordered last; identical rows
(same id and text) share one random number and are taken together; an empty
table gives an empty result; input columns keep their names, columns named like
an output column, in any case, give way to it; of a text only its words are counted,
whatever its length.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, checked_broadcast, materialise, n_words

BITS = 10  # bits of the rank per histogram pass
RANK_BITS = 40  # bits of the rank that are looked at
WIDTH = 60  # bits of U


def _unit_hash(key: Column, text: Column, seed: int) -> Column:
    """60 random bits, the same in every run and engine."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), text))
    return F.conv(F.substring(digest, 1, WIDTH // 4), 16, 10).cast("long")


def pareto_rank(u: Column, p: Column) -> Column:
    """Q / (1 + Q), in the same order as Q: the random odds of a document over its inclusion odds."""
    unit = (u.cast("double") + 0.5) / F.lit(float(1 << WIDTH))
    take, leave = unit * (1 - p), p * (1 - unit)
    return F.when(p >= 1, F.lit(0.0)).otherwise(take / (take + leave))


def _weight() -> Column:
    return F.floor(F.sqrt(F.col("_size").cast("double"))).cast("long")


def inclusion(base: DataFrame, sources: DataFrame) -> DataFrame:
    """(_src, _rest, _c, _most): words still to draw, factor of the inclusion probability, and the largest weight that is drawn; larger ones are certain."""
    groups = base.filter(F.col("_size") > 0).groupBy("_src", _weight().alias("_k")).agg(F.sum("_size").alias("_sum")).withColumnRenamed("_src", "_s")
    rows = groups.join(sources.select("_src", "_rest"), F.col("_s").eqNullSafe(F.col("_src"))).drop("_s")
    down = Window.partitionBy("_src").orderBy(F.desc("_k"))
    above = F.sum("_sum").over(down) - F.col("_sum")
    upto = F.sum(F.col("_k") * F.col("_sum")).over(Window.partitionBy("_src").orderBy("_k"))
    tried = rows.withColumn("_above", above).withColumn("_upto", upto)
    tried = tried.withColumn("_left", F.col("_rest") - F.col("_above")).withColumn("_c", F.col("_left") / F.col("_upto"))
    fits = tried.filter((F.col("_c") * F.col("_k") <= 1) & (F.col("_left") >= 0))
    best = fits.groupBy("_src").agg(F.max_by(F.struct("_left", "_c", "_k"), "_k").alias("x"))
    return best.select("_src", F.col("x._left").alias("_rest"), F.col("x._c").alias("_c"), F.col("x._k").alias("_most"))


def source_weights(totals: DataFrame, cycle: tuple[int, ...]) -> DataFrame:
    """Weights ``cycle`` repeated over the sources in code point order, null last.

    Positions come from a range partitioning and the row counts of its
    partitions, so no task holds all sources."""
    parts = materialise(totals.repartitionByRange(F.col("_src").asc_nulls_last())
                        .withColumn("_pid", F.spark_partition_id()), "sources")
    counts = parts.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_pid").orderBy(F.col("_src").asc_nulls_last())) - 1
    pos = (F.col("_local") + F.col("_before")) % len(cycle)
    return (parts.withColumn("_local", local).join(checked_broadcast(before), "_pid")
            .select("_src", "_words", F.element_at(F.array(*[F.lit(w) for w in cycle]), (pos + 1).cast("int")).alias("_w")))


def water_level(sources: DataFrame, max_copies: int) -> float:
    """The level L with sum(min(cap, L * weight)) = all words; each round is one aggregate of the sources table."""
    cap = F.col("_words") * max_copies
    total = sources.agg(F.sum("_words")).first()[0] or 0
    level = -1.0
    while True:
        above = cap < F.lit(level) * F.col("_w")
        capped, weight = sources.agg(F.coalesce(F.sum(F.when(above, cap)), F.lit(0)),
                                     F.coalesce(F.sum(F.when(~above, F.col("_w"))), F.lit(0))).first()
        new = (total - capped) / weight if weight else 0.0
        if new <= level:
            return level
        level = new


def _cuts(base: DataFrame, drawn: DataFrame) -> DataFrame:
    """Per source the last rank (``_cut_v``, ``_cut_u``) that is taken: the prefix of the Pareto order whose words come nearest to ``_rest``."""
    some = drawn.filter((F.col("_rest") > 0) & (F.col("_c") > 0))
    ranked = base.filter(F.col("_size") > 0).select("_src", "_size", "_u").withColumnRenamed("_src", "_s").join(
        checked_broadcast(some.select("_src", "_c", "_most")), F.col("_s").eqNullSafe(F.col("_src")))
    ranked = ranked.filter(_weight() <= F.col("_most")).select("_src", "_size", "_u", pareto_rank(F.col("_u"), F.col("_c") * _weight()).alias("_v"))
    rows = ranked.withColumn("_bits", F.floor(F.col("_v") * float(1 << RANK_BITS)).cast("long"))
    state = some.select("_src", "_rest", F.lit(0.0).alias("_done"), F.lit(0).cast("long").alias("_prefix"))
    left = RANK_BITS
    for _ in range(2):
        bucket = F.shiftright(F.col("_bits"), left - BITS)
        here = rows if left == RANK_BITS else rows.join(
            checked_broadcast(state.select(F.col("_src").alias("_s"), "_prefix")),
            F.col("_src").eqNullSafe(F.col("_s")) & (F.shiftright(F.col("_bits"), left) == F.col("_prefix"))).drop("_s", "_prefix")
        hist = here.groupBy("_src", bucket.alias("_b")).agg(F.sum("_size").alias("_sum"))
        cum = F.sum("_sum").over(Window.partitionBy("_src").orderBy("_b"))
        joined = hist.withColumn("_cum", cum).withColumnRenamed("_src", "_s").join(
            state, F.col("_s").eqNullSafe(F.col("_src")))
        reached = F.col("_done") + F.col("_cum") >= F.col("_rest")
        # Rounding may leave the last bucket a hair below the rest; then it is the one.
        first = joined.groupBy("_src").agg(F.min_by(F.struct("_b", "_cum", "_sum", "_rest", "_done"), F.struct(~reached, F.when(reached, F.col("_b")).otherwise(-F.col("_b")))).alias("x"))
        state = materialise(first.select("_src", F.col("x._rest").alias("_rest"),
                                         (F.col("x._done") + F.col("x._cum") - F.col("x._sum")).alias("_done"),
                                         F.col("x._b").alias("_prefix")), "cut")
        left -= BITS
    # The last bucket: about a millionth of the unit interval.
    last = rows.join(checked_broadcast(state.withColumnRenamed("_src", "_s")),
                     F.col("_src").eqNullSafe(F.col("_s")) & (F.shiftright(F.col("_bits"), left) == F.col("_prefix")))
    by_rank = last.groupBy("_src", "_v", "_u", "_rest", "_done").agg(F.sum("_size").alias("_sum"))
    cum = F.col("_done") + F.sum("_sum").over(Window.partitionBy("_src").orderBy("_v", "_u"))
    off = F.abs(F.col("_cum") - F.col("_rest"))
    none = F.abs(F.col("_done") - F.col("_rest"))
    at = F.struct("_v", "_u")
    best = by_rank.withColumn("_cum", cum).groupBy("_src").agg(F.min_by(at, F.struct(off, at)).alias("_best"), F.min(off).alias("_off"), F.min(none).alias("_none"), F.min(at).alias("_first"))
    near = F.col("_off") <= F.col("_none")
    return best.select("_src", F.when(near, F.col("_best._v")).otherwise(F.col("_first._v")).alias("_cut_v"), F.when(near, F.col("_best._u")).otherwise(F.col("_first._u") - 1).alias("_cut_u"))


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id",
                carry: list[str] | None = None, weights: tuple[int, ...] = (1, 2, 3), max_copies: int = 3,
                seed: int = 20) -> DataFrame:
    """Rows of ``docs`` (columns ``carry``, default all) with size, source_size, target, copies and taken.

    ``copies`` is the number of times the mix takes the document (0 included)."""
    names, rest = carried(docs, carry, ["size", "source_size", "target", "copies", "taken"])
    size = n_words(docs[text])
    base = materialise(docs.select(
        F.struct(F.lit(0).alias("_"), *rest).alias("_row"), docs[source].alias("_src"), size.alias("_size"),
        _unit_hash(docs[key], docs[text], seed).alias("_u")), "mix")
    totals = base.groupBy("_src").agg(F.sum("_size").alias("_words"))
    sources = source_weights(totals, weights)
    level = water_level(sources, max_copies)
    target = F.least((F.col("_words") * max_copies).cast("double"), F.lit(level) * F.col("_w"))
    whole = F.when(F.col("_words") > 0, F.floor(F.col("_target") / F.col("_words") + F.lit(1e-12))).otherwise(0)
    sources = materialise(sources.withColumn("_target", target).withColumn("_whole", whole.cast("long"))
                          .withColumn("_rest", F.greatest(F.lit(0.0), F.col("_target") - F.col("_whole") * F.col("_words"))),
                          "targets")
    drawn = materialise(inclusion(base, sources.filter(F.col("_rest") > 0)), "inclusion")
    cuts = _cuts(base, drawn)
    side = lambda df, name: df.withColumnRenamed("_src", name)
    plan = (sources.select(F.col("_src").alias("_s"), "_words", "_target", "_whole")
            .join(side(drawn.drop("_rest"), "_ds"), F.col("_s").eqNullSafe(F.col("_ds")), "left")
            .join(side(cuts, "_cs"), F.col("_s").eqNullSafe(F.col("_cs")), "left").drop("_ds", "_cs"))
    joined = base.join(checked_broadcast(plan), F.col("_src").eqNullSafe(F.col("_s")))
    rank = F.struct(pareto_rank(F.col("_u"), F.col("_c") * _weight()).alias("v"), F.col("_u").alias("u"))
    taken = F.when(_weight() > F.col("_most"), True).otherwise(rank <= F.struct(F.col("_cut_v").alias("v"), F.col("_cut_u").alias("u")))
    extra = F.when((F.col("_size") > 0) & F.col("_c").isNotNull() & (F.col("_cut_v").isNotNull() | (_weight() > F.col("_most"))), taken.cast("long")).otherwise(0)
    copies = F.least(F.col("_whole") + extra, F.lit(max_copies).cast("long"))
    return (joined.withColumn("_copies", copies)
            .select(*[F.col("_row").getField(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("_size").alias("size"),
                    F.col("_words").alias("source_size"), F.col("_target").alias("target"),
                    F.col("_copies").alias("copies"), (F.col("_size") * F.col("_copies")).alias("taken")))
