"""Sinks and file sources on small fixtures written to the scratch folder."""
import json
import os
import uuid

from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir
from tessera.sources import relations as R
from tessera.sources import sinks as K
from tessera.sources import store as ST


def scratch(spark):
    return f"{ensure_checkpoint_dir(spark)}/test-{uuid.uuid4().hex}"


def test_read_lines_and_terms(spark):
    d = scratch(spark)
    os.makedirs(d)
    with open(f"{d}/vocab.txt", "w") as f:
        f.write(" Swift\n\tswift \nSwift\n")
    lines = R.read_lines(spark, f"{d}/vocab.txt")
    assert sorted((r.line_no, r.value) for r in lines.collect()) == [(1, " Swift"), (2, "\tswift "), (3, "Swift")]
    assert sorted(r.term for r in R.terms_from_lines(lines).collect()) == ["Swift", "swift"]


def test_metrics_predictions_fanout_glossary(spark):
    d = scratch(spark)
    m = spark.createDataFrame([("m", 0, 0.5, 0.6, 0.55, 0.7)], "model string, fold int, recall double, precision double, f1 double, accuracy double")
    K.write_metrics_csv(m, f"{d}/csv")
    assert spark.read.option("header", True).csv(f"{d}/csv").count() == 1
    p = spark.createDataFrame([("m", 1, 0, "yes", 0.9)], "model string, run int, fold int, label string, p_yes double")
    K.write_predictions(p, f"{d}/pred")
    assert os.path.isdir(f"{d}/pred/model=m/run=1/fold=0")
    f = spark.createDataFrame([("a", "b", 0.9, 0.5), ("a", "b", 0.9, 0.6)], "w1 string, w2 string, score double, threshold double")
    K.write_threshold_fanout(f, f"{d}/fan")
    assert sorted(tuple(r) for r in spark.read.parquet(f"{d}/fan/counts").collect()) == [(0.5, 1), (0.6, 1)]
    g = spark.createDataFrame([("actor", "A person")], "term string, definition string")
    K.write_glossary(g, f"{d}/gloss")
    assert [r.value for r in spark.read.text(f"{d}/gloss").collect()] == ["actor:A person"]


def test_pages_overwrite_and_resume(spark):
    d = scratch(spark)
    a = spark.createDataFrame([("m", "q1", "t1"), ("m", "q2", "t2")], "mission string, query string, text string")
    K.write_pages(a, d)
    K.write_pages(spark.createDataFrame([("m", "q1", "new")], "mission string, query string, text string"), d)
    got = sorted(r.value for r in spark.read.text(d).collect())
    assert got == ["new", "t2"]
    K.write_pages(spark.createDataFrame([("m", "q2", "more")], "mission string, query string, text string"), d, resume=True)
    assert spark.read.text(d).count() == 3


def test_tables_create_drop(spark):
    K.create_table_if_not_exists(spark, "tessera_docs_t", "query string, content string", scratch(spark))
    K.create_table_if_not_exists(spark, "tessera_docs_t", "query string, content string")
    assert spark.catalog.tableExists("tessera_docs_t")
    K.drop_table_if_exists(spark, "tessera_docs_t")
    assert not spark.catalog.tableExists("tessera_docs_t")


def test_directory_dispatch_and_skip_done(spark):
    d = scratch(spark)
    os.makedirs(f"{d}/in/sub")
    for name, body in [("a.txt", b"hello"), ("sub/b.TXT", b"world"), ("c.bin", b"\x00")]:
        with open(f"{d}/in/{name}", "wb") as f:
            f.write(body)
    files = K.read_directory(spark, f"{d}/in")
    out, rejects = K.convert_directory(files, {".txt": lambda b: b.decode().upper()})
    assert sorted(r.text for r in out.collect()) == ["HELLO", "WORLD"]
    assert [r.extension for r in rejects.collect()] == [".bin"]
    done = out.filter(F.col("text") == "HELLO").select("path")
    out2, _ = K.convert_directory(files, {".txt": lambda b: b.decode()}, done=done)
    assert [r.text for r in out2.collect()] == ["world"]


def test_sharded_dump(spark):
    dump = json.dumps({"0": {"merge": "[]", "cache": json.dumps([{"term": "cache", "definition": "fast memory"}])},
                       "9": {}})
    rows = ST.read_sharded_dump(spark.createDataFrame([(dump,)], "value string")).collect()
    got = sorted((r.shard, r.term, None if r.item is None else r.item.definition) for r in rows)
    assert got == [("0", "cache", "fast memory"), ("0", "merge", None)]


def test_decode_json_array_empty(spark):
    df = spark.createDataFrame([("",), (None,), ('[{"term":"a","definition":"b"}]',)], "c string")
    sizes = [r.n for r in df.select(F.size(ST.decode_json_array("c", "struct<term:string,definition:string>")).alias("n")).collect()]
    assert sizes == [0, 0, 1]


def test_judged_csv_rejects(spark):
    d = scratch(spark)
    os.makedirs(d)
    with open(f"{d}/judged.csv", "w") as f:
        f.write("assumptions,assumption,s\nschedule performance\nx,y,hypon\n")
    ok, bad = R.read_judged_csv(spark, f"{d}/judged.csv")
    assert sorted((r.w1, r.w2, r.code) for r in ok.collect()) == [("assumptions", "assumption", "s"), ("x", "y", "hypon")]
    assert [r._corrupt_record for r in bad.collect()] == ["schedule performance"]


def test_see_also_strict_and_default(spark):
    from tessera.operators import features as FT
    df = spark.createDataFrame([("standard", "See also standard model, cache and queue. Rest.")], "w string, t string")
    row = df.select(FT.listed_in_see_also("w", "t").alias("a"), FT.listed_in_see_also("w", "t", strict=True).alias("b")).first()
    assert (row.a, row.b) == (0, 0)
    df = spark.createDataFrame([("cache", "See also standard model, cache and queue. Rest.")], "w string, t string")
    row = df.select(FT.listed_in_see_also("w", "t").alias("a"), FT.listed_in_see_also("w", "t", strict=True).alias("b")).first()
    assert (row.a, row.b) == (1, 0)
