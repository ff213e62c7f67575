"""Line numbers and running sums of files read in many splits against a sequential read."""
import random

from pyspark.sql import functions as F

from tessera.plans import catalog, q_eval
from tessera.sources import lines as L


def _texts():
    r = random.Random(2)
    plain = "".join("".join(r.choices("abcdé \t", k=r.choice([0, 1, 5, 40, 400]))) + "\n" for _ in range(6000))
    crlf = "\r\n".join(str(i) * r.randint(0, 30) for i in range(3000))
    wide = "head\n" + "x" * 300_000 + "\n\n\nend"
    return {"a.txt": plain, "b.txt": crlf, "c.txt": wide, "d.txt": "", "e.txt": "\n\n\n", "f.txt": "one line, no end"}


def test_numbers_of_split_files(spark, tmp_path):
    texts = _texts()
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = L.numbered_lines(spark, str(tmp_path))
        rows = L.running_sum(got, F.length("value"), "chars").collect()
        folder = L.numbered_lines(spark, str(tmp_path), by_folder=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want, every = {}, []
    for name, text in texts.items():
        lines = text.replace("\r\n", "\n").split("\n")
        lines = lines[:-1] if lines[-1] == "" else lines
        want[name] = lines
        every += lines
    for name, lines in want.items():
        mine = sorted((r["line_no"], r["value"], r["chars"]) for r in rows if r["file"].endswith("/" + name))
        total, expect = 0, []
        for i, v in enumerate(lines):
            total += len(v)
            expect.append((i + 1, v, total))
        assert mine == expect, name
    assert len({r["block"] for r in rows if r["file"].endswith("a.txt")}) > 20
    assert [r["value"] for r in sorted(folder, key=lambda r: r["line_no"])] == every and len({r["log"] for r in folder}) == 1


def test_log_read_in_splits(spark, tmp_path, sf_small):
    catalog.load()
    small = q_eval.parse_prediction_log(q_eval.prediction_log(spark, sf_small)).filter("file = 'm1'").drop("file")
    log = q_eval.prediction_log(spark, sf_small).filter("file = 'm1'").orderBy("line_no").select("value")
    log.coalesce(1).write.text(f"{tmp_path}/log")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        lines = L.numbered_lines(spark, f"{tmp_path}/log")
        got = q_eval.parse_prediction_log(lines).drop("file")
        assert sorted(map(str, got.collect())) == sorted(map(str, small.collect())) and lines.select("block").distinct().count() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_no_files_with_lines(spark, tmp_path):
    (tmp_path / "x").write_text("")
    assert L.running_sum(L.numbered_lines(spark, str(tmp_path)), F.lit(1), "n").count() == 0
