"""Interval joins as equi-joins on position bins.

An interval is dealt to every bin that it touches and a point to its own; an equi-join on
(chromosome, bin) and the exact predicate follow.  The bin is part of the key, so one large
chromosome spreads over many partitions.  Two intervals meet only in the bin where the
later of them begins, so no pair comes twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN = 1024


def _bin(position: Column, width: int) -> Column:
    return F.floor(position / F.lit(width)).cast("long")


def point_in_interval(intervals: DataFrame, points: DataFrame, chr_i: str, lo: Column, hi: Column, chr_p: str, pos: str, width: int = BIN) -> DataFrame:
    """Inner join of intervals with the points that lie in [lo, hi]; column names must differ."""
    left = intervals.where(lo <= hi).withColumn("_bin", F.explode(F.sequence(_bin(lo, width), _bin(hi, width))))
    right = points.withColumn("_pbin", _bin(F.col(pos), width))
    on = (F.col(chr_i) == F.col(chr_p)) & (F.col("_bin") == F.col("_pbin")) & (F.col(pos) >= lo) & (F.col(pos) <= hi)
    return left.join(right, on).drop("_bin", "_pbin")


def overlapping(left: DataFrame, right: DataFrame, chr_l: str, beg_l: str, end_l: str, chr_r: str, beg_r: str, end_r: str, width: int = BIN) -> DataFrame:
    """Inner join of closed intervals that share a position; column names must differ."""
    deal = lambda df, b, e, name: df.where(F.col(b) <= F.col(e)).withColumn(name, F.explode(F.sequence(_bin(F.col(b), width), _bin(F.col(e), width))))
    on = (
        (F.col(chr_l) == F.col(chr_r))
        & (F.col("_lbin") == F.col("_rbin"))
        & (F.col(beg_l) <= F.col(end_r))
        & (F.col(beg_r) <= F.col(end_l))
        & (F.col("_lbin") == _bin(F.greatest(beg_l, beg_r), width))
    )
    return deal(left, beg_l, end_l, "_lbin").join(deal(right, beg_r, end_r, "_rbin"), on).drop("_lbin", "_rbin")
