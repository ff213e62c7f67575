"""Importance resampling against plain Python with zlib.crc32."""
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import resample as R


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=700), min_size=1, max_size=8))
def test_crc_of_spans(parts):
    data = np.frombuffer(b"".join(parts), np.uint8)
    end = np.cumsum([len(p) for p in parts])
    assert R.Crc().spans(data, end - [len(p) for p in parts], end).tolist() == [zlib.crc32(p) for p in parts]


def test_long_and_overlapping_spans():
    data = np.random.default_rng(1).integers(0, 256, 3_000_000, dtype=np.uint8)
    start, end = np.array([0, 5, 5, 64, 1000]), np.array([3_000_000, 69, 70, 2_500_001, 1001])
    assert R.Crc().spans(data, start, end).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, end, strict=True)]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def runs(text, n):
    ws = words(text)
    return [" ".join(ws[i:i + k]) for k in range(1, n + 1) for i in range(len(ws) - k + 1)]


TEXTS = ["", None, "One two-two ÉÉ", "x" * 500 + " y", "...", " a", "b ", "a b c", "Ünï 😀 z9", "w" * 200_000 + " tail"]


def test_blocks(monkeypatch):
    monkeypatch.setattr(R, "SLICE", 40)
    monkeypatch.setattr(R, "BLOCK", 64 * 64)
    for n in (1, 3):
        got = [[] for _ in TEXTS]
        for owner, bucket in R.feature_blocks(pa.array(["skip me", *TEXTS])[1:], n, 997):
            for o, b in zip(owner.tolist(), bucket.tolist(), strict=True):
                got[o].append(b)
        assert [sorted(g) for g in got] == [sorted(zlib.crc32(f.encode()) % 997 for f in runs(t, n)) for t in TEXTS]


def brute(rows, target, n, buckets, least, percent, seed):
    def hist(texts):
        out = [0] * buckets
        for t in texts:
            for f in runs(t, n):
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out
    s, t = hist(r[1] for r in rows), hist(target)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for d, text in rows:
        f = runs(text, n)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    can = sorted((o for o in out if o[1] >= least), key=lambda o: (-o[4], -1 if o[0] is None else o[0]))
    for o in out:
        o.append(None)
    for i, o in enumerate(can[: len(can) * percent // 100]):
        o[5] = i + 1
    return sorted(map(tuple, out), key=str)


def test_against_plain_python(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choices(["alpha", "Beta", "gamma", "delta.", "ß", "q" * 90], k=r.randint(0, 30)))) for i in range(300)]
    rows += [(None, "alpha beta gamma"), (None, None), (7, ""), (400, "beta " * 20_000)] + [(-5, "alpha gamma delta")] * 2
    target = ["beta gamma", None, "delta beta beta"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS Score", "1 AS c0", "2 AS _row", "3 AS `a.b`", "'k' AS _key")
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    for n, least, percent in ((1, 3, 30), (2, 0, 100), (1, 10_000_000, 50)):
        got = R.resample(docs, bench, max_run=n, buckets=50, least_words=least, percent=percent, seed=9)
        assert got.columns == ["doc_id", "text", "c0", "_row", "a.b", "_key", "n_words", "n_features", "weight", "score", "rank"]
        mine = sorted((tuple(x[c] for c in ("doc_id", "n_words", "n_features", "weight", "score", "rank")) for x in got.collect()), key=str)
        want = brute(rows, target, n, 50, least, percent, 9)
        assert mine == want
    assert R.resample(docs.limit(0), bench).count() == 0
    assert R.resample(docs, bench.limit(0)).count() == len(rows)
