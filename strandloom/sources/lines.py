"""Text lines with their numbers, whatever the splits and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import scratch_path


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, n (0-based within the file) and value of every line.

    Lines are read once, with their file, split and running number, into a scratch table, so that
    all that follows sees one numbering.  The splits' line counts (a row a split) give each
    split the number of its first line; no file is ordered by one task.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("i"), "value")
    at = scratch_path(spark, "lines")
    raw.write.parquet(at)
    lines = spark.read.schema(raw.schema).parquet(at)
    sizes = lines.groupBy("file", "split").agg(F.min("i").alias("_first"), F.count("*").alias("_count"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("file").alias("_file"), F.col("split").alias("_split"), "_first", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_base"))
    met = lines.join(starts, (F.col("file") == F.col("_file")) & (F.col("split") == F.col("_split")))
    return met.select("file", (F.col("i") - F.col("_first") + F.col("_base")).alias("n"), "value")
