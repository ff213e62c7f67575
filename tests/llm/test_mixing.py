"""Targets, copies and samples against plain Python."""
import re

import pytest

from tessera.llm import mixing as M
from tessera.llm.queries import QUERIES


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def targets(sizes):
    """Water filling by repeated resharing over sources in order."""
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        w = sum(weight[s] for s in sizes if s not in full)
        over = {s for s in sizes if s not in full and rest * weight[s] > 3 * sizes[s] * w}
        if not over:
            return {s: 3 * sizes[s] if s in full else rest * weight[s] / w if w else 0 for s in sizes}
        full |= over


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_table(spark, sf):
    d = f"/root/testdata/{sf}"
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    got = QUERIES["op2_mix_sources"](spark, d).collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in QUERIES["op2_mix_sources"](spark, d).collect())
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((r["doc_id"], words(r["text"])) for r in docs)
    sizes, taken, largest = {}, {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
        assert r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 3
    want = targets(sizes)
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, r["target"]) and r["source_size"] == sizes[r["source"]]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1


def test_edge_rows(spark):
    rows = [(1, "b", "a b c"), (2, None, "one two three four"), (2, None, "one two three four"), (3, "a", None), (4, "a", " \n"), (None, "\U0001F600", "x " * 20000),
            (5, "￿", "y z")] + [(10 + i, "c", "w " * (i % 7 + 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "'q' AS size", "1 AS _src")
    got = M.mix_sources(df).collect()
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    want = targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1.0, r["target"])
    twins = [r for r in got if r["doc_id"] == 2]
    assert twins[0] == twins[1]
    assert M.mix_sources(df.limit(0)).count() == 0
    assert all(r["taken"] == 0 for r in M.mix_sources(df.filter("source = 'a'")).collect())


def test_many_sources_have_positions(spark):
    rows = [(i, f"s{i:04d}", "w " * (1 + i % 5)) for i in range(500)]
    got = {r["source"]: r["target"] for r in M.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    want = targets({s: words(t) for _, s, t in rows})
    assert all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_inclusion_follows_size(spark):
    """Over many seeds a document is taken as often as its probability says, and the words come near the target each time."""
    rows = [(i, "a", "w " * (1 if i < 60 else 16 if i < 90 else 2500)) for i in range(91)] + [(1000 + i, "b", "w " * 10) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").coalesce(1).cache()
    seen, n = {}, 12
    for seed in range(n):
        out = M.mix_sources(df, weights=(1, 6), seed=seed).collect()
        for r in out:
            seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + r["copies"]
        one = [r for r in out if r["source"] == "a"]
        assert one[0]["copies"] <= 3 and abs(sum(r["taken"] for r in one) - one[0]["target"]) <= 1250
    df.unpersist()
    small, large = sum(seen[i] for i in range(60)) / 60 / n, sum(seen[i] for i in range(60, 90)) / 30 / n
    # floor(sqrt(size)) is 1 and 4, so the odds of inclusion differ.
    assert small <= large


def test_pareto_rank(spark):
    got = spark.createDataFrame([(1 << 59, 0.5), (1 << 59, 0.9), ((1 << 60) - 1, 0.5), (0, 1.0), (0, 1e-300)], "u long, p double").select(M.pareto_rank(M.F.col("u"), M.F.col("p"))).collect()
    assert [round(r[0], 12) for r in got] == [0.5, 0.1, 1.0, 0.0, 1.0]
