"""Site tables: dense ranks, duplicates and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Positions counted together when ranks are made.
RANK_BIN = 1 << 20


def dedup_sites(sites: DataFrame) -> DataFrame:
    return sites.dropDuplicates(["chr", "pos"])


def rank_sites(sites: DataFrame) -> DataFrame:
    """Add ``rk``, the 0-based rank of a site within its chromosome.

    Ranks are counted within position bins and the bins' counts added up, so a large
    chromosome is not sorted by one task.
    """
    binned = sites.withColumn("_bin", F.floor(F.col("pos") / RANK_BIN))
    before = Window.partitionBy("chr").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    base = binned.groupBy("chr", "_bin").count().select(F.col("chr").alias("_b_chr"), F.col("_bin").alias("_b_bin"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("chr", "_bin").orderBy("pos")
    ranked = binned.withColumn("_rn", F.row_number().over(inner) - 1)
    out = ranked.join(base, (F.col("chr") == F.col("_b_chr")) & (F.col("_bin") == F.col("_b_bin")))
    return out.select(*sites.columns, (F.col("_rn") + F.col("_base")).cast("long").alias("rk"))


def invalid_sites(sites: DataFrame) -> DataFrame:
    """Sites that occur more than once or have no positive position."""
    return sites.groupBy("chr", "pos").count().where((F.col("count") > 1) | (F.col("pos") <= 0) | F.col("pos").isNull())


def check_sites(sites: DataFrame) -> DataFrame:
    """The sites; raises ValueError if any is invalid."""
    bad = invalid_sites(sites).limit(5).collect()
    if bad:
        raise ValueError(f"sites must be unique with positive positions: {[tuple(r) for r in bad]}")
    return sites
