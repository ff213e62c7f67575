"""Event-time credit fold over micro-batches with late rows and idle keys against the batch rule."""
import datetime as dt
import random

import pytest

from tessera.operators.state import step
from tessera.streaming.ordered_credit import ordered_credit_stream

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def brute(rows, idle):
    out, state = {}, {}
    for k, t, i, ok in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        c, w, a, last = state.get(k, (0, 0, False, None))
        if last is not None and idle is not None and (t - last).total_seconds() > idle:
            c, w, a = 0, 0, False
        c, w, a, s = step(c, w, a, ok)
        state[k] = (c, w, a, t)
        out[i] = (s, c, w, a)
    return out


def run(spark, tmp, batches, idle):
    schema = "k long, t timestamp, id long, ok boolean, note string"
    for i, rows in enumerate(batches):
        spark.createDataFrame([(*r, f"n{r[2]}") for r in rows], schema).coalesce(1).write.mode("append").parquet(f"{tmp}/in")
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/in").withWatermark("t", "1 hour")
    q = (ordered_credit_stream(s, "k", "t", ["id"], "ok", idle).writeStream.format("parquet").option("path", f"{tmp}/out")
         .option("checkpointLocation", f"{tmp}/ck").outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(240)
    return {r["id"]: (r["skipped"], r["credit"], r["waiting"], r["available"], r["note"]) for r in spark.read.parquet(f"{tmp}/out").collect()}, len([p for p in q.recentProgress if p["numInputRows"]])


@pytest.mark.parametrize("idle", [None, 1800])
def test_late_rows_and_idle_keys(rocks, tmp_path, idle):
    r = random.Random(idle or 0)
    start = dt.datetime(2024, 1, 1)
    rows = [(k, start + dt.timedelta(minutes=3 * n + r.randint(0, 2), seconds=r.randint(0, 59)), 100 * k + n, r.random() < 0.55) for k in range(4) for n in range(60) if not (k == 2 and 20 < n < 40)]
    # Rows come up to 40 minutes after their time, in four micro-batches; a last row moves the watermark on.
    came = sorted(rows, key=lambda x: x[1] + dt.timedelta(minutes=r.randint(0, 40)))
    batches = [came[i * len(came) // 4:(i + 1) * len(came) // 4] for i in range(4)] + [[(99, start + dt.timedelta(days=2), 9999, True)]]
    got, n = run(rocks, str(tmp_path), batches, idle)
    want = brute(rows, idle)
    assert n >= 4
    assert {i: g[:4] for i, g in got.items()} == want and all(g[4] == f"n{i}" for i, g in got.items())
    assert all(max(x[1] for x in a) > min(x[1] for x in b) for a, b in zip(batches[:3], batches[1:4], strict=True))
