"""Pair features (F8-F26) as column expressions and join-based vector scores.

Per-term material (tokens, stems, document bags, definitions) is computed once
per *term* and joined to pairs by equi joins on ``w1`` / ``w2``; long text never
travels with the pair rows through a shuffle until the candidate set is final.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stem_native as SN
from ..functions import text as T
from ..session import written
from . import phrase_vectors as PV

BLOCK = 1 << 18  # entries of pairs that a task looks up at once


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# F14
def common_token_len(a, b) -> Column:
    """Size of the set intersection of two token arrays."""
    return F.size(F.array_intersect(F.array_distinct(_c(a)), _c(b)))


# F15
def same_last_token(a, b) -> Column:
    return (T.at(_c(a), -1) == T.at(_c(b), -1)).cast("int")


# F16
def same_first_token(a, b) -> Column:
    return (T.at(_c(a), 1) == T.at(_c(b), 1)).cast("int")


# F17
def token_num_same(a, b) -> Column:
    return (F.size(_c(a)) == F.size(_c(b))).cast("int")


# F18
def edit_distance(w1, w2) -> Column:
    """Levenshtein distance with unit costs, over code points."""
    return F.levenshtein(_c(w1), _c(w2))


# F19
def one_side_single_token(a, b) -> Column:
    return (F.size(_c(a)) == 1).cast("int") + (F.size(_c(b)) == 1).cast("int")


# F24 / F25
def token_count(a) -> Column:
    return F.size(_c(a))


# F21
def same_suffix_len(w1, w2, max_len: int = 5) -> Column:
    """Number of equal trailing letters of the two last tokens, at most ``max_len``.
    Prefix equality of the reversed tokens is monotone in the length, so the
    common length is the number of lengths whose prefixes agree."""
    a = F.reverse(F.coalesce(T.at(T.term_tokens(_c(w1)), -1), F.lit("")))
    b = F.reverse(F.coalesce(T.at(T.term_tokens(_c(w2)), -1), F.lit("")))
    n = F.least(F.length(a), F.length(b), F.lit(max_len))
    agree = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, 1, i) == F.substring(b, 1, i))
    return F.when(n == 0, F.lit(0)).otherwise(F.size(agree))


# F8 / F9
def term_count_in_text(term, text) -> Column:
    """Non-overlapping matches, letters of any script in either case, of whitespace + term + one
    whitespace char in the text (term quoted, so ``C++`` is a literal)."""
    quoted = F.regexp_replace(_c(term), r"([\\^$.|?*+()\[\]{}\-])", r"\\$1")
    pat = F.concat(F.lit("(?iu)[" + T.WS + "]+"), quoted, F.lit("[" + T.WS + "]"))
    return F.coalesce(F.regexp_count(F.coalesce(_c(text), F.lit("")), pat), F.lit(0))


# F12 / F13
def listed_in_see_also(term, text, strict: bool = False) -> Column:
    """Term is one of the items of the other side's see-also clause (0/1).

    Default: items split on commas or the whole word "and", trimmed.
    ``strict=True`` keeps the reference's literal behaviour: split on "," or
    on "and" anywhere (also inside words) and compare untrimmed items."""
    t = F.coalesce(_c(text), F.lit(""))
    if strict:
        items = F.split(T.see_also_clause(t), ",|and", -1)
    else:
        items = T.see_also_items(t)
    return F.array_contains(items, _c(term)).cast("int")


def pair_token_features(pairs: DataFrame, t1: str = "t1", t2: str = "t2") -> DataFrame:
    """F14-F19 from token arrays ``t1``/``t2`` already on the pair rows."""
    return (pairs
            .withColumn("common_tokens", common_token_len(t1, t2))
            .withColumn("same_last", same_last_token(t1, t2))
            .withColumn("same_first", same_first_token(t1, t2))
            .withColumn("same_count", token_num_same(t1, t2))
            .withColumn("edit_distance", edit_distance("w1", "w2"))
            .withColumn("single_sides", one_side_single_token(t1, t2)))


def rule_score() -> Column:
    """A transparent rule score from F14-F18 used where no model is trained."""
    return ((F.lit(2) * F.col("common_tokens") + F.col("same_last") + F.col("same_first") + F.col("same_count"))
            + F.lit(1.0) / (F.lit(1) + F.col("edit_distance"))) / F.lit(6.0)


# ------------------------------------------------------------ bag cosine
def term_bags(docs: DataFrame, term: str = "term", text: str = "text") -> DataFrame:
    """Per-term bag of words: (term, tok, n). Tokens are lower-cased word runs
    with stop words removed. Partial aggregation happens map-side."""
    toks = docs.select(F.col(term).alias("term"),
                       F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[" + T.WORD + "]+"), F.lit(0))).alias("tok"))
    toks = toks.filter(~T.is_stop_word(F.col("tok")))
    return toks.groupBy("term", "tok").agg(F.count(F.lit(1)).alias("n"))


def _chunk_dots(block: int):
    """The function of one chunk, made here so that it travels to the workers whole."""
    def dots(bags: pa.Table, pairs: pa.Table) -> pa.Table:
        """Dot products of the pairs (w1, w2) over one chunk's tokens; bags (side, term, tok, n): side 1 of w1, 2 of w2, 0 of both."""
        if not bags.num_rows or not pairs.num_rows:
            return pa.schema([("w1", pa.string()), ("w2", pa.string()), ("dot", pa.int64())]).empty_table()
        terms = pc.unique(bags["term"])
        term = pc.index_in(bags["term"], value_set=terms).to_numpy().astype("int64")
        words = bags["tok"].combine_chunks().dictionary_encode()
        width, key = len(words.dictionary), term * len(words.dictionary) + words.indices.to_numpy()
        side, n = bags["side"].to_numpy(), bags["n"].to_numpy()

        def entries(other: int):
            """Sorted keys (term, token) of one side and their counts."""
            keys, at = np.unique(key[side != other], return_inverse=True)
            counts = np.zeros(len(keys), "int64")
            np.add.at(counts, at, n[side != other])
            return keys, counts

        keys1, counts1 = entries(2)
        keys2, counts2 = (keys1, counts1) if not side.any() else entries(1)
        w1, w2 = [pc.index_in(pairs[w], value_set=terms) for w in ("w1", "w2")]
        pairs = pairs.filter(pc.and_(w1.is_valid(), w2.is_valid()))
        w1, w2 = [pc.index_in(pairs[w], value_set=terms).to_numpy().astype("int64") for w in ("w1", "w2")]
        start = np.searchsorted(keys1, w1 * width)
        size = np.searchsorted(keys1, (w1 + 1) * width) - start
        ends = np.cumsum(size)
        dot, hits = np.zeros(len(w1), "int64"), np.zeros(len(w1), "int64")
        a = 0
        while a < len(w1):  # blocks of pairs: their entries on the first side are looked up on the second
            before = ends[a] - size[a]
            b = max(a + 1, int(np.searchsorted(ends, before + block, side="right")))
            pair = np.repeat(np.arange(a, b), size[a:b])
            at = np.arange(len(pair)) - (ends[pair] - size[pair] - before) + start[pair]
            look = keys1[at] + (w2 - w1)[pair] * width
            place = np.minimum(np.searchsorted(keys2, look), max(0, len(keys2) - 1))
            same = keys2[place] == look if len(keys2) else np.zeros(len(look), bool)
            sums = np.concatenate([[0], np.cumsum(np.where(same, counts1[at] * counts2[place], 0))]) if len(keys2) else np.zeros(len(look) + 1, "int64")
            seen = np.concatenate([[0], np.cumsum(same)])
            last = ends[a:b] - before
            dot[a:b], hits[a:b] = sums[last] - sums[last - size[a:b]], seen[last] - seen[last - size[a:b]]
            a = b
        met = pa.array(hits > 0)
        return pa.table({"w1": pairs["w1"], "w2": pairs["w2"], "dot": pa.array(dot)}).filter(met)
    return dots


def bag_cosine(pairs: DataFrame, bags: DataFrame, out: str = "cosine", bags2: DataFrame | None = None) -> DataFrame:
    """Cosine of the two terms' bags for each pair, as a sparse dot product.

    dot(w1, w2) = sum over shared tokens of n1 * n2. Bags are dealt by token into
    chunks (the shuffle partitions, which follow the data) and meet the pairs in
    every chunk, so a pair's tokens are never rows of a shuffle, only its partial
    sums. Counts are integers so the result does not depend on summation order.
    Pairs with an empty side get 0.
    ``bags2`` (default ``bags``) is the bag table of the second side, e.g. a
    term's own tokens against the other term's definition (F10, F11).
    """
    bags2 = bags if bags2 is None else bags2
    norms = bags.groupBy("term").agg(F.sum(F.col("n") * F.col("n")).alias("nn"))
    norms2 = bags2.groupBy("term").agg(F.sum(F.col("n") * F.col("n")).alias("nn"))
    keys = pairs.select("w1", "w2").distinct()
    chunks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = lambda df, n: df.filter(F.col("term").isNotNull() & F.col("tok").isNotNull()).select(
        F.pmod(F.xxhash64("tok"), F.lit(chunks)).cast("int").alias("_chunk"), F.lit(n).alias("side"), "term", "tok", F.col("n").cast("long").alias("n"))
    sides = part(bags, 0) if bags2 is bags else part(bags, 1).unionByName(part(bags2, 2))
    every = keys.filter(F.col("w1").isNotNull() & F.col("w2").isNotNull()).select(
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("_to"), "w1", "w2")
    dots = (sides.repartition(chunks, "_chunk").groupBy("_chunk").cogroup(every.repartition(chunks, "_to").groupBy("_to"))
            .applyInArrow(_chunk_dots(BLOCK), "w1 string, w2 string, dot long").groupBy("w1", "w2").agg(F.sum("dot").alias("_dot")))
    n1 = norms.select(F.col("term").alias("w1"), F.col("nn").alias("_nn1"))
    n2 = norms2.select(F.col("term").alias("w2"), F.col("nn").alias("_nn2"))
    scored = (keys.join(dots, ["w1", "w2"], "left").join(n1, "w1", "left").join(n2, "w2", "left")
              .withColumn(out, F.when(F.col("_dot").isNull() | F.col("_nn1").isNull() | F.col("_nn2").isNull(), F.lit(0.0))
                          .otherwise(F.col("_dot") / F.sqrt(F.col("_nn1").cast("double") * F.col("_nn2").cast("double"))))
              .select("w1", "w2", out))
    return pairs.join(scored, ["w1", "w2"], "left")


# F22
def related_overlap(pairs: DataFrame, terms: DataFrame, syn: DataFrame, out: str = "related_overlap") -> DataFrame:
    """Size of the intersection of the two sides' related sets: a term's tokens
    plus the related words of its tokens from a (tok, rel) table. Built once per
    term, joined to pairs on (term, tok)."""
    side = terms.select("term", F.explode(F.array_distinct(T.term_tokens("term"))).alias("tok")).distinct()
    related = side.unionByName(side.join(syn, "tok").select("term", F.col("rel").alias("tok"))).distinct()
    a = related.select(F.col("term").alias("w1"), "tok")
    b = related.select(F.col("term").alias("w2"), "tok")
    keys = pairs.select("w1", "w2").distinct()
    cnt = keys.join(a, "w1").join(b, ["w2", "tok"]).groupBy("w1", "w2").agg(F.count(F.lit(1)).alias(out))
    return pairs.join(cnt, ["w1", "w2"], "left").fillna(0, subset=[out])


def vector_cosine(a, b) -> Column:
    """Cosine of two equal-length numeric arrays (zip + aggregate, JVM-side)."""
    a, b = _c(a), _c(b)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    na = F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    nb = F.aggregate(F.transform(b, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot / F.sqrt(na * nb))


# pluggable feature list. Each entry builds one numeric column from a pair
# row that carries w1, w2, token arrays t1/t2 and the definitions def1/def2.
FEATURES = {
    "w1_in_def2": lambda: term_count_in_text("w1", "def2"),
    "w2_in_def1": lambda: term_count_in_text("w2", "def1"),
    "w1_see_also2": lambda: listed_in_see_also("w1", "def2"),
    "w2_see_also1": lambda: listed_in_see_also("w2", "def1"),
    "common_tokens": lambda: common_token_len("t1", "t2"),
    "same_last": lambda: same_last_token("t1", "t2"),
    "same_first": lambda: same_first_token("t1", "t2"),
    "same_count": lambda: token_num_same("t1", "t2"),
    "edit_distance": lambda: edit_distance("w1", "w2"),
    "single_sides": lambda: one_side_single_token("t1", "t2"),
    "suffix_len": lambda: same_suffix_len("w1", "w2"),
    "n_tokens_1": lambda: token_count("t1"),
    "n_tokens_2": lambda: token_count("t2"),
}


def assemble(df: DataFrame, names: list[str], out: str = "features", registry: dict | None = None) -> DataFrame:
    """Feature vector (array<double>) in the given order from a name -> column
    builder registry; users add entries to extend the vector."""
    reg = registry or FEATURES
    return df.withColumn(out, F.array(*[reg[n]().cast("double") for n in names]))


# F26 in the reference's order: similarities of phrase vectors, definition counts and similarities,
# see-also flags, token features on stems.
SIMILARITIES = {"q1_sim": ("q1", "q1"), "a1_sim": ("a1", "a1"), "r1_sim": ("r1", "r1"), "a2_sim": ("a2", "a2"), "q2_sim": ("q2", "q2"), "r2_sim": ("r2", "r2"),
                "def_sim": ("def", "def"), "w1_def2_sim": ("name", "def"), "w2_def1_sim": ("def", "name")}
ALL_FEATURES = ["q1_sim", "a1_sim", "r1_sim", "a2_sim", "q2_sim", "r2_sim", "def_sim", "w1_in_def2", "w2_in_def1", "w1_def2_sim", "w2_def1_sim",
                "w1_see_also2", "w2_see_also1", "common_tokens", "same_last", "same_first", "same_count", "edit_distance", "single_sides"]


def term_material(terms: DataFrame, texts: DataFrame, definitions: DataFrame, vectors: DataFrame, dims: int | None = None, chunks: int | None = None) -> DataFrame:
    """One row a term: term, stems, definition ('' if none), vecs (map of field to vector, with the fields name and def).

    ``texts`` (term, field, text) is read once; definitions and names join it as fields of their own."""
    terms = terms.select("term").filter(F.col("term").isNotNull()).distinct()
    stems = written(SN.stems_of(terms.select("term", T.split_tokens("term").alias("tokens"))), "stems")  # each side of the pairs reads them
    fields = texts.select("term", "field", "text").unionByName(definitions.select("term", F.lit("def").alias("field"), F.col("definition").alias("text")))
    fields = fields.unionByName(terms.select("term", F.lit("name").alias("field"), F.col("term").alias("text")))
    vecs = PV.by_term(PV.phrase_vectors(fields, vectors, dims, chunks, terms))
    found = stems.join(definitions.select("term", "definition"), "term", "left").join(vecs, "term", "left")
    return found.select("term", "stems", F.coalesce("definition", F.lit("")).alias("definition"), "vecs")


# Features of both terms and the first one's definition: made before the join of the second side, which that text then does not enter.
FIRST_SIDE = ["w2_in_def1", "w2_see_also1"]


def all_features(pairs: DataFrame, material: DataFrame) -> DataFrame:
    """``pairs`` (w1, w2, ...) with the columns of ``ALL_FEATURES``: one join of ``term_material`` for each side.

    Pairs with a term that the material lacks get similarities 0, counts 0 and null token features."""
    side = lambda n: material.select(F.col("term").alias(f"w{n}"), F.col("stems").alias(f"t{n}"), F.col("definition").alias(f"def{n}"), F.col("vecs").alias(f"_v{n}"))
    has = material.select(F.col("term").alias("w2"), F.map_keys("vecs").alias("_has"))
    rows = pairs.join(has, "w2", "left").join(side(1), "w1", "left")
    rows = rows.select(*pairs.columns, "t1", *[FEATURES[n]().alias(f"_{n}") for n in FIRST_SIDE], *[v.alias(f"_1{i}") for i, v in enumerate(PV.first_side(SIMILARITIES).values())])
    rows = rows.join(side(2), "w2", "left")
    made = {n: FEATURES[n]() for n in ALL_FEATURES if n in FEATURES} | {n: F.col(f"_{n}") for n in FIRST_SIDE} | PV.similarities(SIMILARITIES)
    return rows.select(*pairs.columns, *[made[n].cast("double").alias(n) for n in ALL_FEATURES])
