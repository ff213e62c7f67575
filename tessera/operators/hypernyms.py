"""Similarity of words in a hypernym graph (F23), from user tables: edges (child, parent) and senses (word, sense).

The depth of a node is 1 at a node without parents and 1 more than its shallowest parent's below. The
similarity of two senses is 2 d / (d + n1 + d + n2): d is the depth of their deepest common ancestor (a
node is its own; ties go to the smaller name), n1 and n2 its distances from the senses. Two words have
the largest similarity over their senses; words are the last tokens of the two terms.

Depths and ancestors are found by frontier joins: each round joins the nodes that are new with the edges
and drops those already known, so a cycle ends by itself; there are as many rounds as levels. Ancestors are
followed only for the senses that the pairs ask for.

Defined results: a word without a sense, or senses without a common ancestor that has a depth, give 0 (a
cycle that no root reaches has no depth); self loops, repeated edges and null ends are ignored; repeated
pairs keep their rows; an empty edge table leaves every sense a root of depth 1."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import ensure_checkpoint_dir


def _clean(edges: DataFrame) -> DataFrame:
    """The edges that count, written once: every round reads them."""
    ensure_checkpoint_dir(edges.sparkSession)
    return edges.select("child", "parent").filter("child IS NOT NULL AND parent IS NOT NULL AND child <> parent").distinct().checkpoint()


def _spread(start: DataFrame, step, key: list[str]) -> DataFrame:
    """Rows of ``start`` (key columns, n) and of all further rounds; each key stays with the round that first finds it."""
    found = frontier = start.checkpoint()
    while True:
        frontier = step(frontier).groupBy(*key).agg(F.min("n").alias("n")).join(found.select(*key), key, "left_anti").checkpoint()
        if frontier.isEmpty():
            return found
        found = found.unionByName(frontier)


def depths(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, depth) of every node that a root reaches; ``nodes`` (node) adds nodes without edges."""
    edges = _clean(edges)
    every = edges.select(F.col("parent").alias("node")).unionByName(edges.select(F.col("child").alias("node")))
    every = every if nodes is None else every.unionByName(nodes.select("node"))
    roots = every.distinct().join(edges, F.col("node") == F.col("child"), "left_anti").select("node", F.lit(1).alias("n"))
    down = lambda f: f.join(edges, F.col("node") == F.col("parent")).select(F.col("child").alias("node"), (F.col("n") + 1).alias("n"))
    return _spread(roots, down, ["node"]).withColumnRenamed("n", "depth")


def ancestors(senses: DataFrame, edges: DataFrame) -> DataFrame:
    """(sense, node, n): every node that a sense reaches upwards and its distance, itself at 0."""
    edges = _clean(edges)
    start = senses.select("sense").distinct().select("sense", F.col("sense").alias("node"), F.lit(0).alias("n"))
    up = lambda f: f.join(edges, F.col("node") == F.col("child")).select("sense", F.col("parent").alias("node"), (F.col("n") + 1).alias("n"))
    return _spread(start, up, ["sense", "node"])


def hypernym_similarity(pairs: DataFrame, senses: DataFrame, edges: DataFrame, out: str = "hypernym_sim") -> DataFrame:
    """``pairs`` (w1, w2, ...) with the similarity of the terms' last tokens."""
    ensure_checkpoint_dir(pairs.sparkSession)
    token = lambda w: F.coalesce(T.at(T.term_tokens(w), -1), F.lit(""))
    asked = pairs.select("w1", "w2").distinct().select("w1", "w2", token("w1").alias("k1"), token("w2").alias("k2")).checkpoint()
    words = asked.select("k1", "k2").distinct()
    known = senses.select("word", "sense").filter("word IS NOT NULL AND sense IS NOT NULL").distinct()
    side = lambda n: known.select(F.col("word").alias(f"k{n}"), F.col("sense").alias(f"s{n}"))
    both = words.join(side(1), "k1").join(side(2), "k2").checkpoint()
    needed = both.select(F.explode(F.array("s1", "s2")).alias("sense")).distinct()
    up = ancestors(needed, edges).join(depths(edges, needed.select(F.col("sense").alias("node"))), "node")
    one = up.select(F.col("sense").alias("s1"), "node", F.col("n").alias("n1"), "depth")
    two = up.select(F.col("sense").alias("s2"), "node", F.col("n").alias("n2"))
    lowest = (both.select("s1", "s2").distinct().join(one, "s1").join(two, ["s2", "node"])
              .groupBy("s1", "s2").agg(F.min_by(F.struct("depth", "n1", "n2"), F.struct(-F.col("depth"), "node")).alias("x")))
    score = 2.0 * F.col("x.depth") / (2 * F.col("x.depth") + F.col("x.n1") + F.col("x.n2"))
    best = both.join(lowest.select("s1", "s2", score.alias("score")), ["s1", "s2"]).groupBy("k1", "k2").agg(F.max("score").alias("_score"))
    rated = asked.join(best, ["k1", "k2"], "left").select("w1", "w2", F.coalesce("_score", F.lit(0.0)).alias(out))
    return pairs.join(rated, ["w1", "w2"], "left")
