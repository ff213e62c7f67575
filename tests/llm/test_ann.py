"""Neighbours against brute force."""
import numpy as np
import pytest

from tessera.llm import ann as A


def brute(rows, k):
    use = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(np.array(v, float)).all() and any(v):
            use.setdefault(i, []).append(np.array(v, float))
    out = {}
    for q in use:
        if q % 100 == 0:
            best = {i: min(float(np.linalg.norm(v - w)) for v in vs for w in use[q]) for i, vs in use.items() if i != q}
            out[q] = sorted((round(d, 9), i) for i, d in best.items())[:k]
    return out


def test_hadamard_is_orthonormal():
    h = A.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16))


def test_edge_rows(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=8).tolist()) for i in range(401)] + [(1000 + i, [1.0] * 8) for i in range(40)] + [(1200, [1.0] * 8)]
    rows += [(1300, None), (1400, []), (1500, [0.0] * 8), (1600, [float("nan")] * 8), (1700, [float("inf")] + [1.0] * 7), (1800, [1.0, None] + [1.0] * 6),
             (1900, [1.0] * 7), (None, [1.0] * 8), (100, rows[100][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS _id")
    out = A.nearest(df, A.F.col("vec_id") % 100 == 0, tables=24, probes=16).collect()
    got = {}
    for o in sorted(out, key=lambda o: (o["query_id"], o["rank"])):
        got.setdefault(o["query_id"], []).append((round(o["score"], 9), o["vec_id"]))
    assert got == brute(rows, 10)


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_small_tables(spark, n):
    rows = [(100 * i, [float(i + 1), 1.0]) for i in range(n)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = A.nearest(df, A.F.col("vec_id") % 100 == 0, k=10, probes=1, tables=1).collect()
    assert len(out) == n * max(0, n - 1)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    from tessera.llm.queries import QUERIES

    d = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=float)
    got = {}
    for o in QUERIES["op7_nearest"](spark, d).collect():
        got.setdefault(o["query_id"], set()).add(o["vec_id"])
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        dist = np.linalg.norm(x - x[ids == q][0], axis=1)
        dist[ids == q] = np.inf
        true = set(ids[np.lexsort((ids, dist))[:10]])
        hit, total = hit + len(true & got[q]), total + len(true)
    print(sf, hit / total)
    assert hit / total >= 0.93


def test_distances_of_very_large_and_small_vectors(spark):
    rows = [(0, [1e200, 0.0]), (1, [2e200, 0.0]), (2, [1e200, 3e200]), (3, [1e-200, 0.0]), (4, [3e-200, 0.0]), (100, [2e-200, 0.0]), (5, [1.0, 1.0])]
    out = A.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), A.F.col("vec_id") % 100 == 0, k=2).collect()
    got = {(o["query_id"], o["rank"]): (o["vec_id"], o["score"]) for o in out}
    assert got[0, 1] == (1, 1e200) and got[0, 2] == (3, 1e200) and got[100, 1] == (3, 1e-200) and got[100, 2] == (4, 1e-200)
    assert A.distances(np.array([[1e308, 0.0], [3.0, 4.0]]), np.array([-1e308, 0.0]))[0] == np.inf


def test_an_id_has_one_vector(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 3.0]), (2, [1.0, 2.0]), (0, [1.0, 0.0])]
    out = A.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), A.F.col("vec_id") == 0).orderBy("rank").collect()
    one = min([1.0, 3.0], key=lambda v: np.array([1.0, v]).tobytes())
    assert sorted((o["vec_id"], o["score"]) for o in out) == [(1, one), (2, 2.0)]
