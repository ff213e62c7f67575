"""Term pairs: canonical keys, relation sets, candidates, negatives, dedupe.

A pair is ``(w1, w2)``. Undirected identity uses the canonical key
``k1 = least(w1, w2), k2 = greatest(w1, w2)``, so "either order" membership is an
equi join (hash/sort-merge) instead of an OR of two orders (nested loop).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .rank import MAX_BROADCAST_BUCKETS, global_rank, md5_int


def canonical(df: DataFrame, w1: str = "w1", w2: str = "w2") -> DataFrame:
    return df.withColumn("k1", F.least(F.col(w1), F.col(w2))).withColumn("k2", F.greatest(F.col(w1), F.col(w2)))


# ---------------------------------------------------------------- predicates
# P1
def same_first_or_last_token(w1, w2) -> Column:
    """Same first or same last whitespace token."""
    a, b = T.term_tokens(w1), T.term_tokens(w2)
    return (T.at(a, 1) == T.at(b, 1)) | (T.at(a, -1) == T.at(b, -1))


def same_first_or_last(a: Column, b: Column) -> Column:
    """P1/P2 on token arrays already computed (e.g. stems)."""
    return (T.at(a, 1) == T.at(b, 1)) | (T.at(a, -1) == T.at(b, -1))


# P3
def share_tokens(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b)


# P4
def not_self(w1="w1", w2="w2") -> Column:
    return F.col(w1) != F.col(w2) if isinstance(w1, str) else w1 != w2


# P5
def pair_in_collection(pairs: DataFrame, collection: DataFrame, directed: bool = True,
                       keep: bool = True) -> DataFrame:
    """Semi (keep=True) or anti (keep=False) join of pairs against a pair collection.

    Directed: key (w1, w2). Undirected: canonical key, so (b, a) matches (a, b)."""
    how = "left_semi" if keep else "left_anti"
    if directed:
        other = collection.select("w1", "w2").distinct()
        return pairs.join(other, ["w1", "w2"], how)
    other = canonical(collection).select("k1", "k2").distinct()
    p = canonical(pairs)
    return p.join(other, ["k1", "k2"], how).drop("k1", "k2")


# ------------------------------------------------------------- relation sets
# J2
def all_relations(*relation_sets: DataFrame) -> DataFrame:
    """Union of relation tables (w1, w2, kind), distinct."""
    out = None
    for r in relation_sets:
        r = r.select("w1", "w2", "kind")
        out = r if out is None else out.unionByName(r)
    return out.distinct()


# A1 / A2 / A3
def first_seen_unordered(df: DataFrame, seq: str = "seq", extra: list[str] | None = None) -> DataFrame:
    """Unordered dedupe keeping the first-seen direction (smallest ``seq``).

    One hash aggregate on the canonical key (partial aggregation map-side), no
    sort of all rows and no window."""
    extra = extra or []
    fields = ["w1", "w2", seq] + extra
    agg = (canonical(df).groupBy("k1", "k2")
           .agg(F.min_by(F.struct(*fields), F.col(seq)).alias("_first")))
    return agg.select(*[F.col("_first." + f).alias(f) for f in fields])


def dedupe_results(df: DataFrame, seq: str = "seq", extra: list[str] | None = None) -> DataFrame:
    """A2: drop self pairs, then unordered first-seen dedupe."""
    return first_seen_unordered(df.filter(F.col("w1") != F.col("w2")), seq, extra)


# --------------------------------------------------------------- candidates
def sub_phrases(term) -> Column:
    """All proper contiguous sub-phrases of a term's whitespace tokens, joined
    by one space (a term of n tokens has n(n-1)/2 + n - 1 of them)."""
    return token_phrases(T.term_tokens(term))


def token_phrases(toks: Column) -> Column:
    """``sub_phrases`` of a token array; a column of its own, or it is split anew for each of them."""
    n = F.size(toks)
    subs = F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda ln: F.transform(
        F.sequence(F.lit(1), n - ln + 1), lambda st: F.array_join(F.slice(toks, st, ln), " "))))
    return F.when(n >= 2, subs).otherwise(F.array().cast("array<string>"))


def phrase_key(term) -> Column:
    """Whitespace-normalised form of a term used as the join key."""
    return F.array_join(T.term_tokens(term), " ")


# J1
def candidate_pairs(vocab: DataFrame, expansion: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """Candidate pairs (w1 from ``vocab``, w2 from ``expansion``): the vocabulary
    term is a proper contiguous sub-phrase of the expansion term (its head,
    modifier or inner phrase), minus self pairs and minus known relations in
    either order.

    The reference pairs every vocabulary term with every expansion term. That
    product is quadratic, and so is pairing every two terms that share a token
    (a hot token would pair a third of the vocabulary with itself). Here each
    expansion term emits only its own sub-phrases, a number fixed by its length,
    and they meet the vocabulary in one equi join on the phrase: the work and
    the output grow linearly with the input, whatever the key skew (a phrase
    key matches at most one distinct vocabulary term)."""
    v = vocab.select(F.col("term").alias("w1")).distinct().withColumn("_k", phrase_key(F.col("w1")))
    e = (expansion.select(F.col("term").alias("w2")).distinct().withColumn("_t", T.term_tokens(F.col("w2")))
         .select("w2", F.explode(F.array_distinct(token_phrases(F.col("_t")))).alias("_k")))
    pairs = e.join(v, "_k").select("w1", "w2").filter(F.col("w1") != F.col("w2"))
    if relations is not None:
        pairs = pair_in_collection(pairs, relations, directed=False, keep=False)
    return pairs


# J3
def not_in_golden(pairs: DataFrame, golden: DataFrame) -> DataFrame:
    return pair_in_collection(pairs, golden, directed=False, keep=False)


# ---------------------------------------------------------------- negatives
def index_terms(vocab: DataFrame, seed: str = "") -> DataFrame:
    """Dense 0-based index of distinct terms in md5(seed|term) order, computed
    without a single-task window (see ``rank.global_rank``)."""
    t = vocab.select("term").distinct().withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), F.col("term"))))
    return global_rank(t, ["_h"], F.substring("_h", 1, 4), "idx", bucket_bound=MAX_BROADCAST_BUCKETS).drop("_h")


def draw_index(draw: Column, side: str, n_terms: int, seed: str) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(seed), draw.cast("string"), F.lit(side)))
    return F.pmod(md5_int(h), F.lit(n_terms))


def _same_pairs(idx: DataFrame, *keys: Column) -> int:
    """Number of unordered pairs of terms that agree on all keys: sum of C(group size, 2)."""
    groups = idx.groupBy(*keys).agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("c"))
    return int(groups.agg(F.sum((F.col("c") * (F.col("c") - 1) / 2).cast("decimal(38,0)"))).first()[0] or 0)


def valid_pair_count(idx: DataFrame, golden: DataFrame, drop_heuristic: bool) -> int:
    """Unordered pairs of different terms that are not golden (and, if asked,
    share neither first nor last token), by inclusion and exclusion of group
    counts: pairs are never formed."""
    gk = canonical(golden).filter(F.col("k1") != F.col("k2")).select("k1", "k2").distinct()
    gk = gk.join(idx.select(F.col("term").alias("k1")), "k1", "left_semi").join(idx.select(F.col("term").alias("k2")), "k2", "left_semi")
    n = idx.count()
    pairs = n * (n - 1) // 2
    if drop_heuristic:
        tokens = T.split_tokens("term")
        first, last = T.at(tokens, 1).alias("f"), T.at(tokens, -1).alias("l")
        pairs -= _same_pairs(idx, first) + _same_pairs(idx, last) - _same_pairs(idx, first, last)
        gk = gk.filter(~same_first_or_last_token(F.col("k1"), F.col("k2")))
    return pairs - gk.count()


# J10
def random_negatives(spark, vocab: DataFrame, golden: DataFrame, factor: int = 4, seed: str = "neg",
                     drop_heuristic: bool = False, n: int | None = None, none_left: str = "error") -> DataFrame:
    """As many random non-self pairs as golden pairs, none of them golden in
    either order (duplicates allowed). Where the golden pairs leave no such pair
    (a small vocabulary, all of it paired), ``none_left="error"`` raises and
    ``none_left="empty"`` gives no rows, as the draws themselves would.
    Draws are md5-hashed so they can be repeated anywhere; ``factor`` x n draws
    are made, doubled until n are valid, and the first n valid draws (by draw
    id) are kept. The vocabulary is never squared.
    """
    if n is None:
        n = golden.count()
    idx = index_terms(vocab, seed)
    v = idx.count()
    if n == 0 or v < 2:
        return spark.createDataFrame([], "draw long, w1 string, w2 string")
    a = idx.select(F.col("idx").alias("i1"), F.col("term").alias("w1"))
    b = idx.select(F.col("idx").alias("i2"), F.col("term").alias("w2"))

    def valid_draws(total: int) -> DataFrame:
        draws = (spark.range(total).withColumnRenamed("id", "draw")
                 .withColumn("i1", draw_index(F.col("draw"), "a", v, seed))
                 .withColumn("i2", draw_index(F.col("draw"), "b", v, seed)))
        pairs = draws.join(a, "i1").join(b, "i2").select("draw", "w1", "w2").filter(F.col("w1") != F.col("w2"))
        if drop_heuristic:
            pairs = pairs.filter(~same_first_or_last_token(F.col("w1"), F.col("w2")))
        return not_in_golden(pairs, golden)

    # Draw ids are stable, so a larger draw keeps every earlier draw: when too
    # few draws survive the filters, draw more (doubling) until n are found. Only
    # when no valid pair exists at all would that never end, so that is counted
    # (without forming pairs) as soon as the first draws fall short.
    total = n * factor
    pairs = valid_draws(total)
    found = pairs.count()
    if found < n and valid_pair_count(idx, golden, drop_heuristic) <= 0:
        if none_left == "empty":
            return spark.createDataFrame([], "draw long, w1 string, w2 string")
        raise ValueError("no pair of different vocabulary terms is left to draw negatives from")
    while found < n:
        total *= 2
        pairs = valid_draws(total)
        found = pairs.count()
    block = max(1, total // (1 << 16) + 1)
    ranked = global_rank(pairs, ["draw"], F.floor(F.col("draw") / F.lit(block)), "_r", bucket_bound=MAX_BROADCAST_BUCKETS)
    return ranked.filter(F.col("_r") < n).drop("_r")


# --------------------------------------------------------------- judgements
# A4
def judged_label_counts(judged: DataFrame, codes: DataFrame) -> DataFrame:
    """Count distinct pairs per relation class.

    ``codes`` maps a judgement code to (cls, swap): a swapped code (e.g. a
    reversed hypernym) flips the pair before counting; unknown codes count as
    ``none``. ``codes`` is a small fixed table, broadcast."""
    j = judged.join(F.broadcast(codes), "code", "left")
    j = (j.withColumn("cls", F.coalesce(F.col("cls"), F.lit("none")))
         .withColumn("_swap", F.coalesce(F.col("swap"), F.lit(False)))
         .withColumn("a", F.when(F.col("_swap"), F.col("w2")).otherwise(F.col("w1")))
         .withColumn("b", F.when(F.col("_swap"), F.col("w1")).otherwise(F.col("w2"))))
    return j.groupBy("cls").agg(F.countDistinct("a", "b").alias("n_pairs"))


# A5
def expansion_stats(vocab: DataFrame, expansion: DataFrame) -> DataFrame:
    """Long form (stat, n): distinct expansion terms, and distinct vocabulary
    terms that are not expansion terms."""
    e = expansion.select("term").distinct()
    n_exp = e.agg(F.count(F.lit(1)).alias("n")).select(F.lit("expansion").alias("stat"), "n")
    only = (vocab.select("term").distinct().join(e, "term", "left_anti")
            .agg(F.count(F.lit(1)).alias("n")).select(F.lit("vocab_only").alias("stat"), "n"))
    return n_exp.unionByName(only)
