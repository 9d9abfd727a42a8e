"""Operators over region tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .interval_join import BIN, overlapping


def bed_to_closed(bed: DataFrame) -> DataFrame:
    """BED rows [beg, end) as 1-based closed intervals, the summary convention."""
    return bed.withColumn("beg", F.col("beg") + 1)


def _target(regions: DataFrame) -> DataFrame:
    return regions.select(F.col("chr").alias("_t_chr"), F.col("beg").alias("_t_beg"), F.col("end").alias("_t_end"))


def overlap_semi(table: DataFrame, regions: DataFrame, width: int = BIN) -> DataFrame:
    """Rows of ``table`` (closed beg, end) that overlap any region, each once.  What overlaps is
    settled by place, so equal rows share their fate and no row needs a number."""
    spans = table.select("chr", "beg", "end").distinct()
    keys = ("chr", "beg", "end")
    hit = overlapping(spans, _target(regions), "chr", "beg", "end", "_t_chr", "_t_beg", "_t_end", width).select(*[F.col(c).alias(f"_h_{c}") for c in keys]).distinct()
    return table.join(hit, [F.col(c) == F.col(f"_h_{c}") for c in keys], "left_semi")


def missed_regions(regions: DataFrame, table: DataFrame, width: int = BIN) -> DataFrame:
    """Regions that no row of ``table`` overlaps."""
    hit = overlapping(regions, _target(table), "chr", "beg", "end", "_t_chr", "_t_beg", "_t_end", width).select(*[F.col(c).alias(f"_h_{c}") for c in ("chr", "beg", "end")]).distinct()
    on = [F.col(c) == F.col(f"_h_{c}") for c in ("chr", "beg", "end")]
    return regions.join(hit, on, "left_anti")


def _carried(df: DataFrame, value: str, order: list[str], out: str, current: bool) -> DataFrame:
    """Add the running maximum of ``value`` within (chr, ordered), up to the current row or
    the one before.  Maxima run within position bins, on top of the bins' own running
    maxima, so that no chromosome is ordered by one task."""
    inner = Window.partitionBy("chr", "_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    before = Window.partitionBy("chr").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    tops = df.groupBy("chr", "_bin").agg(F.max(value).alias("_top")).select(F.col("chr").alias("_c"), F.col("_bin").alias("_b"), F.max("_top").over(before).alias("_top"))
    run = df.withColumn("_run", F.max(value).over(inner))
    met = run.join(tops, (F.col("chr") == F.col("_c")) & (F.col("_bin") == F.col("_b")))
    return met.withColumn(out, F.greatest("_run", "_top")).drop("_run", "_top", "_c", "_b")


def compact(regions: DataFrame, gap: int = 1) -> DataFrame:
    """Merge closed intervals that overlap or touch."""
    binned = regions.select("chr", "beg", "end", F.floor(F.col("beg") / (1 << 20)).alias("_bin"))
    reached = _carried(binned, "end", ["beg", "end"], "_reach", False)
    marked = reached.withColumn("_start", F.when(F.col("_reach").isNull() | (F.col("beg") > F.col("_reach") + gap), F.col("beg")))
    islands = _carried(marked, "_start", ["beg", "end"], "_island", True)
    return islands.groupBy("chr", "_island").agg(F.min("beg").alias("beg"), F.max("end").alias("end")).select("chr", "beg", "end")


def merged_with_previous(regions: DataFrame) -> DataFrame:
    """``compact`` regions, each with the end of the one before it on its chromosome (null: none)."""
    binned = compact(regions).withColumn("_bin", F.floor(F.col("beg") / (1 << 20)))
    return _carried(binned, "end", ["beg"], "previous", False).select("chr", "beg", "end", "previous")


def listed(regions: DataFrame) -> DataFrame:
    """The order of a region list: begin ascending, the longer first."""
    return regions.orderBy("chr", "beg", F.desc("end"))
