"""Line numbers over splittable text files.

Spark reads a text file in splits, each by some task, a line belonging to the split in which it begins.
Rows of a split keep their order, so a line's number is the number of lines in the splits before it plus its
place in its own split. The splits' line counts are one small table (a row for each split, prefix
sums by log); lines are neither sorted nor sent to one task. A log is a file, or a folder whose files
follow each other by name.

Lines are written once with their places before they are counted, as a file that is read twice might be
split differently the second time.

Defined results: numbers begin at 1; empty lines count, a line break at the end of a file opens no line; a file
without any character has no lines; line breaks are \\n, \\r\\n or \\r; compressed files are one split."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written


def numbered_lines(spark: SparkSession, path: str | list[str], by_folder: bool = False, recursive: bool = False) -> DataFrame:
    """(log, file, block, line_no, value) of all lines; ``log`` is the file, or its folder with ``by_folder``."""
    raw = spark.read.option("recursiveFileLookup", recursive).text(path)
    file = F.col("_metadata.file_path")
    held = raw.select(file.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_at"), "value")
    held = written(held, "lines").withColumn("log", F.regexp_replace("file", "/[^/]*$", "") if by_folder else F.col("file"))
    splits = held.groupBy("log", "file", "block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy("log").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("log", "file", "block", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    joined = held.join(splits, ["log", "file", "block"])
    return joined.select("log", "file", "block", (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("line_no"), "value")


def running_sum(lines: DataFrame, value: Column, out: str) -> DataFrame:
    """``lines`` of ``numbered_lines`` with the sum of ``value`` over all lines of the log up to each line: inside
    its split, plus the sums of the splits before it. No task holds more than one split of a log."""
    rows = lines.withColumn("_v", value.cast("long"))
    inside = F.sum("_v").over(Window.partitionBy("log", "file", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    splits = rows.groupBy("log", "file", "block").agg(F.sum("_v").alias("_sum"))
    earlier = Window.partitionBy("log").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("log", "file", "block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    summed = rows.withColumn("_inside", inside).join(splits, ["log", "file", "block"])
    return summed.select(*lines.columns, (F.col("_inside") + F.col("_before")).alias(out))
