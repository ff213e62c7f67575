"""W5 fold golden vector, brute-force twin, and stream = batch over several micro-batches."""
import uuid

import pandas as pd
from pyspark.sql import functions as F

from tessera.operators import state as S
from tessera.session import ensure_checkpoint_dir
from tessera.streaming import credit as SC
from tessera.streaming import upsert as SU
from tessera.sources import store as ST


def test_credit_worked_vector(spark):
    ev = spark.createDataFrame([("p", 1, False), ("p", 2, True), ("p", 3, False), ("p", 4, True)],
                               "k string, t long, ok boolean")
    got = [(r.credit, r.waiting, r.skipped) for r in S.credit_fold(ev, "k", ["t"], "ok").orderBy("t").collect()]
    assert got == [(1, 1, False), (1, 0, True), (2, 2, False), (2, 1, True)]


def _brute(rows):
    out, state = {}, {}
    for k, t, ok in sorted(rows):
        c, w, a = state.get(k, (0, 0, False))
        c, w, a, s = S.step(c, w, a, ok)
        state[k] = (c, w, a)
        out[(k, t)] = (c, w, a, s)
    return out


def test_credit_matches_brute_force(spark):
    rows = [(k, t, (t * 7 + k) % 3 != 0) for k in range(5) for t in range(60)]
    ev = spark.createDataFrame(rows, "k long, t long, ok boolean")
    got = {(r.k, r.t): (r.credit, r.waiting, r.available, r.skipped) for r in S.credit_fold(ev, "k", ["t"], "ok", 3).collect()}
    assert got == _brute(rows)


def _split_events(spark, tmp):
    rows = [(k, t, (t * 5 + k) % 4 != 0) for k in range(4) for t in range(30)]
    pdf = pd.DataFrame(rows, columns=["k", "t", "ok"])
    for i in range(3):  # three files = three micro-batches in time order
        part = pdf[(pdf.t >= i * 10) & (pdf.t < (i + 1) * 10)]
        spark.createDataFrame(part).coalesce(1).write.parquet(f"{tmp}/in/f{i}")
    return rows


def test_stream_credit_equals_batch(spark):
    tmp = f"{ensure_checkpoint_dir(spark)}/test-{uuid.uuid4().hex}"
    rows = _split_events(spark, tmp)
    schema = "k long, t long, ok boolean"
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp}/in")
    q = (SC.credit_stream(s, "k", ["t"], "ok").writeStream.format("parquet").option("path", f"{tmp}/out")
         .option("checkpointLocation", f"{tmp}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    got = {(r.k, r.t): (r.credit, r.waiting, r.available, r.skipped) for r in spark.read.parquet(f"{tmp}/out").collect()}
    assert got == _brute(rows)


def test_stream_upsert_equals_batch_and_is_idempotent(spark):
    tmp = f"{ensure_checkpoint_dir(spark)}/test-{uuid.uuid4().hex}"
    rows = [(k % 7, f"c{k}", k, k) for k in range(50)]
    pdf = pd.DataFrame(rows, columns=["key", "content", "version", "event_id"])
    for i in range(3):
        spark.createDataFrame(pdf.iloc[i::3]).coalesce(1).write.parquet(f"{tmp}/in/f{i}")
    schema = "key long, content string, version long, event_id long"
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp}/in")
    SU.upsert_stream(s, f"{tmp}/store", ["key"], "version", "event_id", f"{tmp}/ck", compact_every=2).awaitTermination()
    got = sorted(tuple(r) for r in SU.read_store(spark, f"{tmp}/store", s.schema, ["key"], "version", "event_id")
                 .select("key", "content", "version", "event_id").collect())
    df = spark.createDataFrame(pdf)
    batch = ST.latest_per_key(df, ["key"], "version", "event_id")
    assert got == sorted(tuple(r) for r in batch.select("key", "content", "version", "event_id").collect())
    again = ST.upsert_last_wins(batch, df, ["key"], "version", "event_id")
    assert sorted(tuple(r) for r in again.collect()) == sorted(tuple(r) for r in batch.collect())


def test_insert_if_absent_first_wins(spark):
    old = spark.createDataFrame([(1, "a", 1)], "key long, content string, version long")
    new = spark.createDataFrame([(1, "z", 5), (2, "b", 3), (2, "c", 2)], "key long, content string, version long")
    got = sorted(tuple(r) for r in ST.insert_if_absent(old, new, ["key"], "version").collect())
    assert got == [(1, "a", 1), (2, "c", 2)]
