"""Prefix trie against a plain Python trie."""
import hashlib
import random
import zlib

import numpy as np
import pytest

from tessera.llm import prefix_trie as P


def brute(sequences):
    """sequences: {conv: list of (turn, code points)}"""
    nodes = {}
    for c, seq in sequences.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(t for t, _ in seq[:d]), []).append(c)
    kids, out = {}, []
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    def under(k):
        last = sequences[nodes[k][0]][len(k) - 1][1] if k else 0
        subs = [under(x) for x in kids.get(k, [])]
        return (sum(s[0] for s in subs) or 1, sum(s[1] for s in subs) + (len(nodes[k]) - 1) * last)
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(sequences[c]) == len(k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(kids.get(k, [])), *under(k), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rebuild(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [((r, t), len(t)) for _, _, r, t in sorted(x)] for c, x in convs.items()}
    out = {}
    for c, x in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + x[h:]
    return out


@pytest.mark.parametrize("columns,shard", [(3, 40), (32, 400_000), (1, 7)])
def test_against_plain_trie(spark, monkeypatch, columns, shard):
    r = random.Random(columns)
    rows = []
    for c in [*range(0, 260), 700, 701, 799, 1000, 5005]:
        if c in (100, 150):
            continue
        same = r.random() < 0.5
        for turn in range(r.choice([0, 1, 2, 5, 8, 9])):
            rows.append((c, turn or None, r.choice(["user", None]) if turn % 2 else "assistant", "same" * turn if same else r.choice(["", None, "héllo", "x" * 9])))
    rows += [(42, 100 + i, "user", f"deep {i}") for i in range(70)] + [(43, 100 + i, "user", f"deep {i}") for i in range(60)]
    rows += [(None, 1, "user", "nobody"), (9_000, 3, "u", "t"), (9_000, 3, "u", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS conv", "'x' AS `key`", "2 AS Depth")
    monkeypatch.setattr(P, "COLUMNS", columns)
    monkeypatch.setattr(P, "SHARD", shard)
    seqs = rebuild(rows)
    want = brute(seqs)
    assert sorted((tuple(x) for x in P.rebuilt_trie(df).collect()), key=str) == want
    # The workers import the module anew, so the matrices are also built here.
    ids = {t: i + 1 for i, t in enumerate(sorted({t for s in seqs.values() for t, _ in s}))}
    flat = np.array([[0, ids[t]] for s in seqs.values() for t, _ in s], np.uint64).reshape(-1, 2)
    parts = P.shard_nodes(flat, np.array([len(s) for s in seqs.values()]), np.array([n for s in seqs.values() for _, n in s]), np.array(list(seqs)), 0)
    whole = [x for p in parts if p["kind"] and p["kind"][0] == P.NODE for x in zip(p["conv"], p["depth"], p["n"], p["kids"], p["leaves"], p["saved"], [d.hex() for d in p["data"]], strict=True)]
    assert len(whole) > 100 and set(map(tuple, whole)) <= {(w[0], w[1], *w[3:]) for w in want}


def test_copies_over_many_tasks(spark, monkeypatch):
    rows = [(c, t, "user", f"turn {t}") for c in range(3000) for t in range(7)] + [(c, 0, "user", "other") for c in range(5000, 5010)]
    monkeypatch.setattr(P, "SHARD", 500)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted((tuple(x) for x in P.rebuilt_trie(df).collect()), key=str) == brute(rebuild(rows))
    assert P.rebuilt_trie(df.limit(0)).count() == 0
