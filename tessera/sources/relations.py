"""Term, relation and definition sources.

Line-oriented inputs are DataFrames ``(file, line_no, value)``: ``read_lines``
makes one from text files; any table can be turned into one with SQL, which is
how the bound test tables feed these parsers. First-wins and last-wins rules
need an order, so the line number is part of the input contract (not
``monotonically_increasing_id``).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def read_lines(spark: SparkSession, path: str, file_order: int | None = None) -> DataFrame:
    """Lines of small text files with their 1-based line number.

    Relation files are small; each file is read whole (``wholetext``) so the
    line number is exact across splits. Use a supplied sequence column for large
    line files instead."""
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    body = F.regexp_replace("value", "\r?\n$", "")
    lines = raw.select("file", F.posexplode(F.split(body, "\r?\n", -1)).alias("pos", "value"))
    lines = lines.select("file", (F.col("pos") + 1).alias("line_no"), "value")
    if file_order is not None:
        lines = lines.withColumn("file_order", F.lit(file_order))
    return lines


# S1
def terms_from_lines(lines: DataFrame) -> DataFrame:
    """Distinct terms, trimmed of spaces, tabs and line breaks."""
    return lines.select(T.strip_chars(F.col("value")).alias("term")).distinct()


# S2
def parse_pair_lines(lines: DataFrame, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``a,b`` lines -> (pairs, rejects). Both sides cleaned with T3.

    Lines without exactly one comma go to the reject table instead of failing
    the job."""
    parts = lines.withColumn("_parts", F.split(T.strip_chars(F.col("value"), " \n"), ",", -1))
    ok = parts.filter(F.size("_parts") == 2)
    bad = parts.filter(F.size("_parts") != 2).drop("_parts")
    pairs = ok.select(
        *[c for c in lines.columns if c != "value"],
        T.clean_phrase(T.at("_parts", 1)).alias("w1"),
        T.clean_phrase(T.at("_parts", 2)).alias("w2"),
    )
    if kind is not None:
        pairs = pairs.withColumn("kind", F.lit(kind))
    return pairs, bad


# S3
def parse_list_lines(lines: DataFrame, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``root:a,b,c`` lines -> one (root, item) pair per item; empty lists skipped.

    The root is kept whole and every item cleaned (T3 after stripping spaces)."""
    parts = lines.withColumn("_parts", F.split(T.strip_chars(F.col("value"), " \n"), ":", -1))
    ok = parts.filter(F.size("_parts") == 2)
    bad = parts.filter(F.size("_parts") != 2).drop("_parts")
    rest = T.at("_parts", 2)
    keep_cols = [c for c in lines.columns if c != "value"]
    items = (ok.filter(rest != "")
             .select(*keep_cols,
                     T.clean_phrase(T.at("_parts", 1)).alias("w1"),
                     F.posexplode(F.split(T.strip_chars(rest, " "), ",", -1)).alias("item_no", "_item"))
             .withColumn("w2", T.clean_phrase(F.col("_item"))).drop("_item"))
    if kind is not None:
        items = items.withColumn("kind", F.lit(kind))
    return items, bad


# S4
def parse_definition_lines(lines: DataFrame) -> DataFrame:
    """``term:text`` lines split on the last colon; the last line of a term wins."""
    m = lines.select(
        "line_no",
        F.regexp_extract("value", r"^(.*):([^:]*)$", 1).alias("term"),
        F.regexp_extract("value", r"^(.*):([^:]*)$", 2).alias("definition"),
        F.col("value").rlike(":").alias("_ok"),
    ).filter("_ok")
    return m.groupBy("term").agg(F.max_by("definition", "line_no").alias("definition"))


# S13
def read_judged_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``w1,w2,code`` CSV lines read in PERMISSIVE mode: malformed lines land in
    ``_corrupt_record`` and are returned as the reject table."""
    lines = spark.read.text(path).filter(F.length("value") > 0)
    # Parsed from lines, as a reader refuses to select its corrupt record column alone.
    row = F.from_csv("value", "w1 string, w2 string, code string, _corrupt_record string",
                     {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    df = lines.select(row.alias("r"))
    ok = df.filter(F.col("r._corrupt_record").isNull()).select("r.w1", "r.w2", "r.code")
    bad = df.filter(F.col("r._corrupt_record").isNotNull()).select("r._corrupt_record")
    return ok, bad
