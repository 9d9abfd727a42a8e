"""Haplotype tables: union, merge and expansion to sites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

IDENTITY = ["chr", "beg", "end", "hap", "strand"]


def union_all(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def merge(*tables: DataFrame, mode: str = "grouped") -> DataFrame:
    """Merge two or more haplotype tables.

    ``grouped`` sums the counts of equal haplotypes.  ``adjacent`` keeps the historic rule:
    tables are folded from the left; rows are ordered with the count before the strand,
    only runs of neighbours are summed, and then equal rows are dropped.
    """
    if len(tables) < 2:
        raise ValueError("merge needs at least two tables")
    if mode == "grouped":
        return union_all(*tables).groupBy(*IDENTITY).agg(F.sum("cnt").cast("long").alias("cnt")).select("chr", "beg", "end", "hap", "cnt", "strand")
    if mode != "adjacent":
        raise ValueError(f"mode must be grouped or adjacent, not {mode!r}")
    return reduce(_merge_adjacent, tables)


def _merge_adjacent(left: DataFrame, right: DataFrame) -> DataFrame:
    key = ["chr", "beg", "end", "hap"]  # runs never cross these, so neither do partitions
    order = Window.partitionBy(*key).orderBy("cnt", "strand")
    marked = left.unionByName(right).withColumn("_new", F.when(F.lag("strand").over(order) == F.col("strand"), 0).otherwise(1))
    runs = marked.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    summed = runs.groupBy(*key, "strand", "_run").agg(F.sum("cnt").cast("long").alias("cnt"))
    return summed.select("chr", "beg", "end", "hap", "cnt", "strand").distinct()


def ordered(table: DataFrame) -> DataFrame:
    """The writers' order."""
    return table.orderBy("chr", "beg", "end", "hap", "cnt", "strand")


def check_alphabet(table: DataFrame) -> DataFrame:
    """The table, with rows whose haplotype holds other than 0 and 1 raising an error."""
    return table.withColumn("hap", F.when(F.col("hap").rlike("^[01]*$"), F.col("hap")).otherwise(F.raise_error(F.concat(F.lit("haplotype is not of 0 and 1: "), F.col("hap")))))


def check_strand(table: DataFrame) -> DataFrame:
    """The table, with rows of unknown strand raising an error."""
    return table.withColumn("strand", F.when(F.col("strand").isin("+", "-"), F.col("strand")).otherwise(F.raise_error(F.concat(F.lit("strand is not + or -: "), F.coalesce("strand", F.lit("null"))))))


def explode_sites(table: DataFrame, sites: DataFrame) -> DataFrame:
    """One row for each site of each haplotype, with its bit.

    The i-th character belongs to the i-th site from ``beg``; it stops at the shorter of
    haplotype and [beg, end], and rows whose ``beg`` lies on a site are found by an equi-join.
    ``sites`` carry ``rk``.
    """
    start = sites.select(F.col("chr").alias("_s_chr"), F.col("pos").alias("_s_pos"), F.col("rk").alias("_s_rk"))
    at = table.join(start, (F.col("chr") == F.col("_s_chr")) & (F.col("beg") == F.col("_s_pos")))
    bits = at.select(*table.columns, "_s_rk", F.posexplode(F.split("hap", "")).alias("_i", "bit"))
    here = sites.select(F.col("chr").alias("_h_chr"), F.col("rk").alias("_h_rk"), F.col("pos"))
    out = bits.join(here, (F.col("chr") == F.col("_h_chr")) & (F.col("_s_rk") + F.col("_i") == F.col("_h_rk")))
    return out.where(F.col("pos") <= F.col("end")).select(*table.columns, "pos", "bit")


def missing_starts(table: DataFrame, sites: DataFrame) -> DataFrame:
    """Haplotypes that do not begin on a site."""
    start = sites.select(F.col("chr").alias("_s_chr"), F.col("pos").alias("_s_pos"))
    return table.join(start, (F.col("chr") == F.col("_s_chr")) & (F.col("beg") == F.col("_s_pos")), "left_anti")


def wrong_ends(table: DataFrame, sites: DataFrame) -> DataFrame:
    """Haplotypes that begin on a site (ranked) but whose last walked site is not their end;
    those that run past the last site of their chromosome are not tested."""
    start = sites.select(F.col("chr").alias("_s_chr"), F.col("pos").alias("_s_pos"), F.col("rk").alias("_s_rk"))
    last = sites.select(F.col("chr").alias("_l_chr"), F.col("pos").alias("_l_pos"), F.col("rk").alias("_l_rk"))
    walked = table.where(F.length("hap") > 0).join(start, (F.col("chr") == F.col("_s_chr")) & (F.col("beg") == F.col("_s_pos"))).withColumn("_rk", F.col("_s_rk") + F.length("hap") - 1)
    met = walked.join(last, (F.col("chr") == F.col("_l_chr")) & (F.col("_rk") == F.col("_l_rk")))
    return met.where(F.col("_l_pos") != F.col("end")).select(*table.columns)
