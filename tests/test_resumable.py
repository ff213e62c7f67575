"""Interrupted writes, repeats, compaction and rival writers of keyed outputs; failing parsers go to the reject table."""
import os

import pytest

from tessera.sources import sinks as K
from tessera.sources.resumable import ResumableOutput
from tests.test_sinks_sources import scratch

SCHEMA = "m string, q string, text string"


def rows(spark, n, step=1):
    return spark.createDataFrame([(None if i % 7 == 0 else f"m{i % 3}", f"query '{i}'/x", f"text {i}") for i in range(0, n, step)], SCHEMA)


def test_interrupted_writes(spark):
    d = scratch(spark)
    out = ResumableOutput(spark, d, SCHEMA, ["m", "q"])
    assert out.read().count() == 0 and out.version() == 0
    assert out.write(rows(spark, 300, 3)) == 100 and out.write(rows(spark, 300, 3)) == 0
    dead = out._write_batch(rows(spark, 300))  # never committed
    assert out.read().count() == 100 and dead in os.listdir(f"{d}/data")
    again = ResumableOutput(spark, d, SCHEMA, ["m", "q"])
    assert again.write(rows(spark, 300)) == 200 and dead not in os.listdir(f"{d}/data")
    want = sorted(map(str, rows(spark, 300).collect()))
    assert sorted(map(str, again.read().collect())) == want and len(again.batches()) == 2
    again.compact()
    assert sorted(map(str, again.read().collect())) == want and len(os.listdir(f"{d}/data")) == len(again.batches()) == 1
    assert again.pending(rows(spark, 310)).count() == 10 and again.write(rows(spark, 0)) == 0


def test_two_writers(spark):
    d = scratch(spark)
    a, b = (ResumableOutput(spark, d, SCHEMA, ["m", "q"]) for _ in range(2))
    first, second = a._write_batch(rows(spark, 10)), b._write_batch(rows(spark, 20))
    a._commit(1, [first])
    with pytest.raises(RuntimeError):
        b._commit(1, [second])
    assert b.read().count() == 10 and not [n for n in os.listdir(f"{d}/manifest") if n.startswith("draft")]


def test_failing_parsers(spark):
    d = scratch(spark)
    os.makedirs(d)
    for name, body in [("a.txt", b"fine"), ("b.txt", b"\xff\xfe"), ("c.bin", b"x"), ("noext", b"y"), ("d.txt", b"also")]:
        with open(f"{d}/{name}", "wb") as f:
            f.write(body)
    out, bad = K.convert_directory(K.read_directory(spark, d), {".txt": lambda b: b.decode()})
    assert sorted(r["text"] for r in out.collect()) == ["also", "fine"]
    got = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in bad.collect()}
    assert got["c.bin"] == got["noext"] == "no parser" and got["b.txt"].startswith("UnicodeDecodeError") and len(got) == 3
