"""Hypernym similarity against a plain search, with cycles, several parents and unknown words."""
import random

from tessera.operators import hypernyms as H


def brute(pairs, senses, edges):
    up = {}
    for c, p in edges:
        if c and p and c != p:
            up.setdefault(c, set()).add(p)
    nodes = {n for e in edges for n in e if n} | {s for _, s in senses}
    depth = {n: 1 for n in nodes if n not in up}
    while True:
        new = {c: 1 + min(depth[p] for p in ps if p in depth) for c, ps in up.items() if any(p in depth for p in ps)}
        if all(depth.get(c) == d for c, d in new.items()):
            break
        depth.update(new)

    def reach(s):
        found, front = {s: 0}, [s]
        while front:
            front = [p for n in front for p in up.get(n, ()) if p not in found and not found.update({p: found[n] + 1})]
        return found
    out = {}
    for a, b in pairs:
        best = 0.0
        for s in {s for w, s in senses if w == a.split()[-1]}:
            for t in {t for w, t in senses if w == b.split()[-1]}:
                x, y = reach(s), reach(t)
                both = sorted((-depth[n], n) for n in x if n in y and n in depth)
                if both:
                    d, n = -both[0][0], both[0][1]
                    best = max(best, 2 * d / (2 * d + x[n] + y[n]))
        out[a, b] = best
    return out


def test_against_plain_search(spark):
    r = random.Random(8)
    names = [f"n{i}" for i in range(40)]
    edges = [(names[i], names[r.randrange(max(1, i))]) for i in range(2, 36) for _ in range(r.randint(1, 2))]
    edges += [("n5", "n30"), ("n3", "n3"), ("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("low", "c1"), (None, "n1"), ("n1", None), edges[0]]
    senses = [(f"w{i}", r.choice(names)) for i in range(30) for _ in range(3)] + [("cy", "c1"), ("lw", "low"), ("alone", "x"), ("nul", None)]
    words = [w for w, _ in senses] + ["unknown", "nul"]
    pairs = [(f"some {r.choice(words)}", r.choice(words)) for _ in range(300)] + [("cy", "lw"), ("alone", "alone"), ("w1", "w1"), ("w1", "w1")]
    df = spark.createDataFrame(pairs, "w1 string, w2 string")
    got = H.hypernym_similarity(df, spark.createDataFrame(senses, "word string, sense string"), spark.createDataFrame(edges, "child string, parent string")).collect()
    want = brute(pairs, senses, edges)
    assert len(got) == len(pairs)
    for x in got:
        assert abs(x["hypernym_sim"] - want[x["w1"], x["w2"]]) < 1e-12, x
    assert want["cy", "lw"] == 0.0 and want["alone", "alone"] == 1.0


def test_empty_tables(spark):
    pairs, senses = spark.createDataFrame([("a", "a"), ("a", "b")], "w1 string, w2 string"), spark.createDataFrame([("a", "s"), ("b", "t")], "word string, sense string")
    edges = spark.createDataFrame([], "child string, parent string")
    assert {r["w2"]: r["hypernym_sim"] for r in H.hypernym_similarity(pairs, senses, edges).collect()} == {"a": 1.0, "b": 0.0}
    assert H.hypernym_similarity(pairs.limit(0), senses, edges).count() == 0
    assert [r[2] for r in H.hypernym_similarity(pairs, senses.limit(0), edges).collect()] == [0.0, 0.0]
