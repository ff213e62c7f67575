"""Registered streaming queries (X1, X2): the events table read as a file
stream, run to completion (available-now trigger), result read back. Their
oracles are the batch twins' SQL: stream and batch must agree."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..operators.state import WAIT_CAP
from ..streaming import credit as SC
from ..streaming import ordered_credit as OC
from ..streaming import upsert as SU
from . import bindings as B
from . import q_store  # noqa: F401  (registers the batch twins whose SQL is reused)
from .catalog import ORACLE, register


def events_stream(spark, d, files_per_batch: int | None = None):
    """The events table as a stream, be it one file or a folder of part files
    (the bracket makes the path a pattern, which may name either)."""
    reader = spark.readStream.schema(B.table(spark, d, "events").schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{d}/events.parque[t]")


def _scratch(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"


# X1 (K6 as a stream)
@register("stream_upsert_events", ORACLE["store_upsert"])
def stream_upsert_events(spark, d):
    base = _scratch(spark, "upsert")
    # Last-wins does not depend on the order of batches, so files may come one by one.
    s = events_stream(spark, d, 1).select(F.col("user_id").alias("key"), F.col("props").alias("content"),
                                       F.col("ts").alias("version"), "event_id")
    q = SU.upsert_stream(s, f"{base}/store", ["key"], "version", "event_id", f"{base}/checkpoint")
    q.awaitTermination()
    return SU.read_store(spark, f"{base}/store", s.schema, ["key"], "version", "event_id")


# X2 (W5 as a stream)
@register("stream_credit_events", ORACLE["credit_fold_events"])
def stream_credit_events(spark, d):
    base = _scratch(spark, "credit")
    # The fold needs each key's events in time order, which files one by one do
    # not promise; one available-now batch holds them all and sorts them per key.
    s = events_stream(spark, d).select("user_id", "event_id", "ts", (F.col("event_type") != "error").alias("ok"))
    out = SC.credit_stream(s, "user_id", ["ts", "event_id"], "ok")
    q = (out.writeStream.format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    r = spark.read.parquet(f"{base}/out")
    return r.select("user_id", "event_id", "ok", "skipped", "credit", "waiting", "available")


# X2 in event-time order: rows wait for the watermark, idle users start anew
IDLE_SECONDS = 12 * 3600


def _credit_sql(idle: int) -> str:
    """The fold by recursion over each user's numbered events."""
    return f"""WITH RECURSIVE e AS (
      SELECT user_id, event_id, ts, event_type <> 'error' AS ok, row_number() OVER w AS n,
        coalesce(epoch_ms(ts) - epoch_ms(lag(ts) OVER w) > {idle * 1000}, false) AS anew
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    f AS (
      SELECT user_id, n, false AS skipped, CASE WHEN ok THEN 0 ELSE 1 END AS credit, CASE WHEN ok THEN 0 ELSE 1 END AS waiting, ok AS available, event_id FROM e WHERE n = 1
      UNION ALL
      SELECT e.user_id, e.n, w0 > 0, CASE WHEN w0 > 0 THEN c0 WHEN ok THEN greatest(c0 - 1, 0) ELSE c0 + 1 END,
        CASE WHEN w0 > 0 THEN w0 - 1 WHEN ok THEN 0 ELSE least({WAIT_CAP}, c0 + 1) END, CASE WHEN w0 > 0 THEN a0 ELSE ok END, e.event_id
      FROM (SELECT e.*, CASE WHEN anew THEN 0 ELSE f.credit END AS c0, CASE WHEN anew THEN 0 ELSE f.waiting END AS w0, CASE WHEN anew THEN false ELSE f.available END AS a0
            FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1) e)
    SELECT user_id, event_id, skipped, credit, waiting, available FROM f"""


@register("stream_credit_ordered", _credit_sql(IDLE_SECONDS))
def stream_credit_ordered(spark, d):
    """Every event of the table, in one available-now run; a last event of a user of its own, later than all, moves the watermark past them."""
    base = _scratch(spark, "credit-ordered")
    events = events_stream(spark, d).select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("ok"))
    # The flush row lies in a folder of its own that the same stream reads.
    last = B.table(spark, d, "events").agg(F.max("ts").cast("timestamp").alias("ts")).select(F.lit(-1).cast("long").alias("user_id"), F.lit(-1).cast("long").alias("event_id"),
                                                                         (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"), F.lit(True).alias("ok"))
    last.write.parquet(f"{base}/flush")
    flush = spark.readStream.schema(last.schema).parquet(f"{base}/flush")
    both = events.unionByName(flush.select(*[F.col(c).cast(events.schema[c].dataType) for c in events.columns])).withWatermark("ts", "1 hour")
    provider, mine = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(provider)
    spark.conf.set(provider, mine)  # the state store of transformWithState; a running query keeps the one it began with
    try:
        q = (OC.ordered_credit_stream(both, "user_id", "ts", ["event_id"], "ok", IDLE_SECONDS).writeStream.format("parquet").option("path", f"{base}/out")
             .option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.parquet(f"{base}/out").select("user_id", "event_id", "skipped", "credit", "waiting", "available")
