"""Components against all-pairs comparison."""
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import components
from tessera.llm import jaccard as J

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, percent):
    sets = [grams(t, k) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(root(i), []).append(d)
    return sorted((d, len(sets[i]), min(least[root(i)])) for i, (d, _) in enumerate(rows))


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    common = " ".join(r.choices(words, k=25))
    texts = []
    for _ in range(n):
        if texts and r.random() < 0.6:
            w = r.choice(texts).split(" ")
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                if w:
                    w[r.randrange(len(w))] = r.choice(words)
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(r.choices(words, k=r.choice([1, 2, 3, 4, 5, 30, 60, 120]))) + (" " + common if r.random() < 0.4 else ""))
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,k,percent", [(1, 4, 85), (2, 5, 80), (3, 4, 85)])
def test_components(spark, seed, k, percent):
    rows = corpus(seed, 250)
    rows += [(1000 + i, " ".join(f"x{j}" for j in range(80)) + f" tail{i % 37} more{i % 11}") for i in range(60)]
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "one"), (2004, "ONE"), (2005, "É é"), (2006, "é é"), (2007, "x " * 30000), (2008, "X\n" * 31000),
             (2009, "a\x85b c d e f"), (2010, "a b"), (2011, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS _class", "2 AS component_id")
    got = sorted(tuple(r) for r in J.near_duplicates(df, width=k, percent=percent).collect())
    assert got == brute(rows, k, percent)


@pytest.mark.parametrize("wide", [512, 5])
def test_every_link(spark, monkeypatch, wide):
    monkeypatch.setattr(J, "WIDE", wide)
    rows = corpus(4, 120) + [(1000 + i, " ".join(f"x{j}" for j in range(80)) + f" tail{i}") for i in range(40)]
    rows += [(1000 + 40 + i, rows[-1 - i][1].upper()) for i in range(5)] + [(2000, None), (2001, ""), (2002, "one"), (2003, "ONE")]
    sets = {i: frozenset(grams(t, 4)) for i, t in rows}
    similar = lambda x, y: x and y and 100 * len(x & y) >= 85 * len(x | y)
    least = {}
    for i, g in sorted(sets.items()):
        least.setdefault(g, i)
    names = sorted(least.values())
    want = {(i, j): (len(sets[i] & sets[j]), len(sets[i] | sets[j])) for i in names for j in names if i < j and similar(sets[i], sets[j])}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(tuple(sorted((r["a_id"], r["b_id"]))), (r["n_common"], r["n_union"])) for r in J.similar_sets(df, width=4, percent=85).collect()]
    assert len(got) == len(want) and dict(got) == want and len(want) > 40 * 39 // 2
    counts = {r["doc_id"]: (r["n_copies"], r["n_links"]) for r in J.link_counts(df, width=4, percent=85).collect()}
    assert counts == {i: (sum(1 for j in sets if j != i and g and sets[j] == g), sum(1 for j in sets if j != i and similar(g, sets[j]))) for i, g in sets.items()}


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert J.near_duplicates(df).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (None, "z"), (7, "q"), (7, "r")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in J.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 3), (None, 3), (3, 3), (None, None), (7, 7), (7, 7)], key=str)


def test_prefix_filter_is_safe():
    r = np.random.default_rng(1)
    level = r.integers(0, 4, 1 << J.COUNTERS).astype(np.uint8)
    for _ in range(300):
        n = int(r.integers(1, 200))
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) > 0.05], r.integers(0, 2**63, int(r.integers(0, max(1, n // 12) + 1))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 85 * (len(a) + len(b) - both):
            continue
        o = -(-85 * (len(a) + len(b)) // 185)
        need = max(1, min(o - int(J.at_least(len(x), 85)) + 1 for x in (a, b)))
        for order in range(J.ORDERS):
            assert len(np.intersect1d(J.prefix(a, level, order, 85), J.prefix(b, level, order, 85))) >= need


def test_query_on_table(spark, sf_small):
    from tessera.llm.queries import QUERIES

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in QUERIES["op9_ngram_join"](spark, sf_small).collect()) == brute(rows, 4, 85)


def test_sketches_differ_in_no_more_bits_than_the_sets():
    rng = np.random.default_rng(3)
    for shared, own in ((50, 0), (50, 5), (300, 40), (1, 900)):
        base = rng.integers(0, 1 << 63, shared + 2 * own, dtype=np.uint64)
        a, b = base[:shared + own], np.concatenate([base[:shared], base[shared + own:]])
        bits = sum(int(x).bit_count() for x in (J.sketch(a) ^ J.sketch(b)).view(np.uint64))
        assert bits <= 2 * own and (own == 0 or bits > 0)


def test_pairs_across_components_are_few_where_sets_are_not_similar(spark):
    rng = np.random.default_rng(5)
    sets = [set(rng.choice(80, 66, replace=False).tolist()) for _ in range(60)]
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in sorted(s))) for i, s in enumerate(sets)], "doc_id long, text string")
    join = J.Join(docs, "text", "doc_id", 1, 80)
    name = {r["_class"]: r["_id"] for r in join.members.collect()}
    met = {tuple(sorted((name[r["a"]], name[r["b"]]))) for r in join.across(join.postings().withColumn("label", F.col("c"))).collect()}
    alike = {(i, j) for i in range(60) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert {(j, i) for i, j in alike} <= met and len(met) < 300


def test_levels_reach_the_driver_as_bytes(spark, monkeypatch):
    rng = np.random.default_rng(11)
    counts = rng.integers(0, 60000, (2, J.BLOCKS, (1 << J.COUNTERS) // J.BLOCKS)) * (rng.random((2, J.BLOCKS, 1)) < 0.5)
    rows = [(b, c[b].astype("<u2").tobytes()) for c in counts for b in range(J.BLOCKS)] + [(None, None)]
    sent, frame = [], type(spark.range(1))
    collect = frame.collect

    def counted(self):
        out = collect(self)
        sent.append(sum(len(v) for r in out for v in r if isinstance(v, (bytes, bytearray))))
        return out

    monkeypatch.setattr(frame, "collect", counted)
    got = J.levels(spark.createDataFrame(rows, "_block int, _counts binary"))
    total = counts.sum(axis=0).reshape(-1)
    assert (got == np.floor(2 * np.log2(np.maximum(total / max(1.0, total.mean()), 1.0)))).all()
    assert max(sent) <= 1 << J.COUNTERS


def rounds(monkeypatch):
    """Numbers of links that rounds of components are given from now on."""
    ran, own = [], components._round
    monkeypatch.setattr(components, "_round", lambda edges: ran.append(edges.count()) or own(edges))
    return ran


def test_stars_and_no_links_take_no_round(spark, monkeypatch):
    ran = rounds(monkeypatch)
    stars = spark.createDataFrame([(1, 5), (1, 6), (6, 1), (7, 7), (2, 9)], "u long, v long")
    assert sorted(map(tuple, components.components(stars).collect())) == [(1, 1), (2, 2), (5, 1), (6, 1), (9, 2)]
    assert components.components(stars.limit(0)).count() == 0 and ran == []


@pytest.mark.parametrize("seed", [1, 2])
def test_more_links_join_known_components(spark, monkeypatch, seed):
    r = random.Random(seed)
    first, more = ([(r.randrange(lo, hi), r.randrange(lo, hi)) for _ in range(n)] for lo, hi, n in ((0, 300, 200), (0, 400, 40)))
    label = {x: x for e in first + more for x in e if e[0] != e[1]}
    for _ in label:
        for a, b in first + more:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    frame = lambda links: spark.createDataFrame(links, "u long, v long")
    known = components.components(frame(first))
    ran = rounds(monkeypatch)
    assert sorted(map(tuple, components.extended(known, frame(more)).collect())) == sorted(label.items())
    assert all(n <= len(more) for n in ran)
    assert components.extended(known, frame(more).limit(0)).count() == known.count()
    chain = components.components(frame([(i, i + 1) for i in range(70)]))
    assert {tuple(x) for x in chain.collect()} == {(i, 0) for i in range(71)}
