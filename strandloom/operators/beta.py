"""Methylation levels of sites and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .haplotypes import check_alphabet, check_strand, explode_sites
from .interval_join import point_in_interval
from .sites import rank_sites


def _percent(meth: str, total: str) -> F.Column:
    return F.expr(f"({meth} * 100) div {total}")


def site_sums(haplotypes: DataFrame, sites: DataFrame, stranded: bool = False) -> DataFrame:
    """chr, pos, strand, meth and total of every covered site."""
    table = check_alphabet(haplotypes)
    if stranded:
        table = check_strand(table)
    ranked = sites if "rk" in sites.columns else rank_sites(sites)
    bits = explode_sites(table, ranked)
    strand = F.col("strand") if stranded else F.lit("*")
    return bits.groupBy("chr", "pos", strand.alias("strand")).agg(
        F.sum(F.when(F.col("bit") == "1", F.col("cnt")).otherwise(0)).cast("long").alias("meth"), F.sum("cnt").cast("long").alias("total")
    )


def site_sums_by_range(haplotypes: DataFrame, sites: DataFrame) -> DataFrame:
    """The same sums by an interval join: also for haplotypes that begin between sites."""
    from pyspark.sql import Window

    table = check_alphabet(haplotypes).withColumn("_id", F.monotonically_increasing_id())
    points = sites.select(F.col("chr").alias("_p_chr"), "pos")
    met = point_in_interval(table, points, "chr", F.col("beg"), F.col("end"), "_p_chr", "pos")
    met = met.withColumn("_i", F.row_number().over(Window.partitionBy("_id").orderBy("pos"))).where(F.col("_i") <= F.length("hap"))
    bit = F.substr(F.col("hap"), F.col("_i"), F.lit(1))
    return met.groupBy("chr", "pos").agg(F.sum(F.when(bit == "1", F.col("cnt")).otherwise(0)).cast("long").alias("meth"), F.sum("cnt").cast("long").alias("total"))


def beta(haplotypes: DataFrame, sites: DataFrame, bed: DataFrame | None = None, stranded: bool = False, compat: bool = False) -> DataFrame:
    """Methylation of every covered site, or of every region of ``bed``.

    Sites: chr, pos, end, pct, meth, unmeth, strand.  Regions (columns chr, beg, end): the
    sums of the sites in [beg, end], the ratio of sums as percent; regions without sites or
    reads have zeros, and with ``stranded`` both strands are always there.  ``compat`` keeps
    the historic rule that a region past the last site reports that site.
    """
    sums = site_sums(haplotypes, sites, stranded)
    if bed is None:
        return sums.where("total > 0").select("chr", "pos", (F.col("pos") + 1).alias("end"), _percent("meth", "total").alias("pct"), "meth", (F.col("total") - F.col("meth")).alias("unmeth"), "strand")
    regions = bed.select("chr", "beg", "end").distinct()
    if compat:
        last = sites.groupBy(F.col("chr").alias("_m_chr")).agg(F.max("pos").alias("_last"))
        regions = regions.join(last, F.col("chr") == F.col("_m_chr"), "left").withColumn("_lo", F.least("beg", F.coalesce("_last", F.col("beg")))).drop("_m_chr", "_last")
        regions = regions.withColumn("_hi", F.greatest("end", "_lo"))
    else:
        regions = regions.withColumn("_lo", F.col("beg")).withColumn("_hi", F.col("end"))
    strands = ["+", "-"] if stranded else ["*"]
    regions = regions.withColumn("strand", F.explode(F.array(*map(F.lit, strands))))
    points = sums.select(F.col("chr").alias("_p_chr"), "pos", F.col("strand").alias("_p_strand"), "meth", "total")
    met = point_in_interval(regions, points, "chr", F.col("_lo"), F.col("_hi"), "_p_chr", "pos").where(F.col("strand") == F.col("_p_strand"))
    rolled = met.groupBy(*[F.col(c).alias(f"_r_{c}") for c in ("chr", "beg", "end", "strand")]).agg(F.sum("meth").cast("long").alias("meth"), F.sum("total").cast("long").alias("total"))
    on = [F.col(c) == F.col(f"_r_{c}") for c in ("chr", "beg", "end", "strand")]
    out = regions.join(rolled, on, "left").select("chr", "beg", "end", "strand", F.coalesce("meth", F.lit(0)).cast("long").alias("meth"), F.coalesce("total", F.lit(0)).cast("long").alias("total"))
    return out.select("chr", "beg", "end", F.when(F.col("total") > 0, F.expr("(meth * 100) div nullif(total, 0)")).otherwise(0).cast("long").alias("pct"), "meth", (F.col("total") - F.col("meth")).alias("unmeth"), "strand")
