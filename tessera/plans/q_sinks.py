"""Registered round trips (S13-S16, K1-K5, K8-K10, K12): rows of the tables written by a sink into the shared folder and read back."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..session import ensure_checkpoint_dir
from ..sources import lines as L
from ..sources import relations as R
from ..sources import resumable as RS
from ..sources import sinks as K
from ..sources import store as ST
from . import bindings as B
from . import duck as D
from . import glossary as G
from . import q_eval as E
from .catalog import ORACLE, register

FILE_BYTES = 16 << 20  # text of one file at most: files are parsed whole


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/sinks/{name}-{uuid.uuid4().hex}"


# K1
@register("sink_metrics_csv", ORACLE["eval_folds"])
def sink_metrics_csv(spark, d):
    rows, path = E.eval_folds(spark, d), _folder(spark, "csv")
    K.write_metrics_csv(rows, path)
    back = spark.read.option("header", True).csv(path)
    return back.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema.fields])


# K2, S16, K3
@register("sink_predictions", f"WITH {E.PRED_SQL} SELECT model, doc_id, label, score FROM pred")
def sink_predictions(spark, d):
    path = _folder(spark, "predictions")
    K.write_predictions(E.predictions(spark, d).select("model", "doc_id", "label", "score"), path)
    return K.read_table(spark, path).select("model", "doc_id", "label", "score")


# K4, A12
@register("sink_threshold_fanout", f"""WITH {E.PRED_SQL}
    SELECT t AS threshold, count(*) AS n_above FROM (SELECT unnest(list_filter([{', '.join(repr(float(t)) + '::DOUBLE' for t in M.FANOUT_THRESHOLDS)}], lambda x: score > x)) AS t FROM pred) GROUP BY t""")
def sink_threshold_fanout(spark, d):
    path = _folder(spark, "fanout")
    K.write_threshold_fanout(M.threshold_fanout(E.predictions(spark, d).select("model", "doc_id", "score"), "score"), path)
    pairs = spark.read.parquet(f"{path}/pairs").groupBy(F.col("threshold").cast("double").alias("threshold")).agg(F.count(F.lit(1)).alias("n_rows"))
    counts = spark.read.parquet(f"{path}/counts")
    return counts.join(pairs, (counts["threshold"] == pairs["threshold"]) & (F.col("n_above") == F.col("n_rows"))).select(counts["threshold"], "n_above")


# K10, S4, S1
@register("sink_glossary", G.with_() + "SELECT term, definition FROM g_defs")
def sink_glossary(spark, d):
    path = _folder(spark, "glossary")
    K.write_glossary(R.parse_definition_lines(G.definition_lines(spark, d)), path)
    return R.parse_definition_lines(L.numbered_lines(spark, path, by_folder=True).select("line_no", "value"))


# Two interrupted writes and a compaction lose and repeat nothing
@register("sink_pages_resumed", "SELECT source AS mission, doc_id AS query, coalesce(text, '') AS text FROM documents")
def sink_pages_resumed(spark, d):
    pages = B.table(spark, d, "documents").select(F.col("source").alias("mission"), F.col("doc_id").alias("query"), F.coalesce("text", F.lit("")).alias("text"))
    out = RS.ResumableOutput(spark, _folder(spark, "pages"), "mission string, query long, text string", ["mission", "query"])
    out.write(pages.filter(F.col("query") % 3 == 0))
    out._write_batch(pages.filter(F.col("query") % 3 == 1))  # as a writer that dies before its commit leaves it
    out.write(pages)
    out.compact()
    out.write(pages)
    return out.read()


# Files by parser; a second run over the finished ones does nothing
@register("sink_directory", f"SELECT line, count(*) AS n FROM (SELECT replace({D.replace_all('text', '[' + chr(13) + chr(10) + ']+', ' ')}, 'a', 'A') AS line FROM documents WHERE text IS NOT NULL) GROUP BY line")
def sink_directory(spark, d):
    path = _folder(spark, "files")
    docs = B.table(spark, d, "documents").filter("text IS NOT NULL")
    files = max(16, -(-(docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // FILE_BYTES))
    docs.select(F.regexp_replace("text", "[\r\n]+", " ").alias("value")).repartition(files).write.text(path)
    files = K.read_directory(spark, path)
    half = files.filter(F.pmod(F.xxhash64("path"), F.lit(2)) == 0)
    parse = {".txt": lambda content: content.decode().replace("a", "A")}
    first, _ = K.convert_directory(half, parse)
    rest, _ = K.convert_directory(files, parse, done=first)
    rows = first.unionByName(rest).select(F.explode(F.split(F.regexp_replace("text", "\n$", ""), "\n", -1)).alias("line"))
    return rows.groupBy("line").agg(F.count(F.lit(1)).alias("n"))


# S14
@register("sink_sharded_dump", G.with_() + "SELECT CAST(ord(term) % 16 AS VARCHAR) AS shard, term, definition FROM g_defs")
def sink_sharded_dump(spark, d):
    defs, path = R.parse_definition_lines(G.definition_lines(spark, d)), _folder(spark, "dump")
    one = F.create_map(F.col("term"), F.to_json(F.array(F.struct("term", "definition"))))
    defs.select(F.to_json(F.create_map((F.ascii("term") % 16).cast("string"), one)).alias("value")).write.text(path)
    rows = ST.read_sharded_dump(spark.read.text(path))
    return rows.select("shard", "term", F.col("item.definition").alias("definition"))


# Judged lines read back, malformed ones rejected
@register("sink_judged_csv", "SELECT CAST(doc_id AS VARCHAR) AS w1, CAST(toxic AS VARCHAR) AS w2, CAST(quality AS VARCHAR) AS code FROM labels WHERE doc_id % 10 <> 0")
def sink_judged_csv(spark, d):
    path = _folder(spark, "judged")
    line = F.concat_ws(",", F.col("doc_id").cast("string"), F.col("toxic").cast("string"), F.col("quality").cast("string"))
    spoiled = F.when(F.col("doc_id") % 10 == 0, F.concat(line, F.lit(",extra,fields"))).otherwise(line)
    B.table(spark, d, "labels").select(spoiled.alias("value")).write.text(path)
    ok, bad = R.read_judged_csv(spark, path)
    return ok
