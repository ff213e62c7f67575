"""Directory splits, chains and groups against plain Python."""
import hashlib
import random

import pyarrow as pa

from tessera.llm import exact_dedup as X


def test_directory_covers_and_splits():
    loads = {p: (100 if p % 7 == 0 else 1) for p in range(256)} | {5: 10_000}
    buckets = X.build_directory(loads, 8, 150)
    assert [b[0] for b in buckets] == [0, *[b[1] for b in buckets[:-1]]] and buckets[-1][1] == 256
    for lo, hi, depth in buckets:
        assert hi - lo == 1 << (8 - depth)
        assert sum(loads.get(p, 0) for p in range(lo, hi)) <= 150 or depth == 8
    owners = X.assign_owners(buckets, loads, 4)
    assert owners == sorted(owners) and set(owners) <= {0, 1, 2, 3}
    assert X.build_directory({}, 4, 10) == [(0, 16, 0)]


def test_equal_keys_with_different_bytes_are_chained():
    rows = [(1, "a", 5, 1, 1), (1, "b", 9, 2, 1), (1, "a", 7, 1, 1), (2, "a", None, 1, 1)]
    cols = list(zip(*rows, strict=True))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["_h", "_text", "_id", "_n", "_best"])
    got = [tuple(r.values()) for b in X._own(iter([batch.slice(0, 1), batch.slice(1)])) for r in b.to_pylist()]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == [(1, 0, sha("a"), 7, 2, 1), (1, 1, sha("b"), 9, 2, 1), (2, 0, sha("a"), None, 1, 1)]


def test_rows(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["", None, "x", "X", "x ", "y" * 100_000, "é", f"own {i}"])) for i in range(500)]
    rows += [(10_000, "twice"), (10_000, "twice"), (9_000, "twice"), (None, "x"), (None, "nobody"), (None, "nobody")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' AS kept", "0 AS _h")
    got = X.mark_duplicates(df).collect()
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    assert len(got) == len(rows)
    stay = {}
    for g in got:
        ids = groups[g["text"] or ""]
        known = [i for i in ids if i is not None]
        assert g["group_size"] == len(ids) and g["keep_id"] == (max(known) if known else None)
        assert g["text_sha256"] == hashlib.sha256((g["text"] or "").encode()).hexdigest()
        stay[g["text"] or ""] = stay.get(g["text"] or "", 0) + g["kept"]
        assert not g["kept"] or g["doc_id"] == g["keep_id"]
    assert set(stay.values()) == {1}
    assert X.mark_duplicates(df.limit(0)).count() == 0
