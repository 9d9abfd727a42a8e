"""Read-level measures of regions and sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .haplotypes import check_strand, missing_starts, wrong_ends
from .interval_join import overlapping
from .sites import rank_sites

MEASURES = ["nReads", "mBase", "tBase", "cBase", "K4plus", "nDR", "nMR"]


def read_measures(haplotypes: DataFrame) -> DataFrame:
    """The seven measures of every haplotype row, times its count."""
    n = F.col("cnt").cast("long")
    size = F.length("hap").cast("long")
    ones = size - F.length(F.replace("hap", F.lit("1"), F.lit("")))
    zero = F.lit(0).cast("long")
    return haplotypes.withColumns({
        "nReads": n,
        "mBase": ones * n,
        "tBase": size * n,
        "cBase": F.when(ones > 0, (size - ones) * n).otherwise(zero),
        "K4plus": F.when(size >= 4, n).otherwise(zero),
        "nDR": F.when((size >= 4) & (ones > 0) & (ones < size), n).otherwise(zero),
        "nMR": F.when((size >= 4) & (ones > 0), n).otherwise(zero),
    })


def _sums() -> list:
    return [F.sum(m).cast("long").alias(m) for m in MEASURES]


def summary_regions(haplotypes: DataFrame, regions: DataFrame, stranded: bool = False) -> DataFrame:
    """Measures of the reads that overlap each region [beg, end] (1-based, closed); reads
    count as a whole, and regions without reads have zeros.  All regions take one join."""
    table = check_strand(haplotypes) if stranded else haplotypes
    reads = read_measures(table).select(F.col("chr").alias("_h_chr"), F.col("beg").alias("_h_beg"), F.col("end").alias("_h_end"), F.col("strand").alias("_h_strand"), *MEASURES)
    wanted = regions.select("ord", "chr", "beg", "end")
    met = overlapping(wanted, reads, "chr", "beg", "end", "_h_chr", "_h_beg", "_h_end")
    strand = F.col("_h_strand") if stranded else F.lit("*")
    rolled = met.groupBy(F.col("ord").alias("_r_ord"), strand.alias("_r_strand")).agg(*_sums())
    strands = ["+", "-"] if stranded else ["*"]
    rows = wanted.withColumn("strand", F.explode(F.array(*map(F.lit, strands))))
    out = rows.join(rolled, (F.col("ord") == F.col("_r_ord")) & (F.col("strand") == F.col("_r_strand")), "left")
    return out.select("ord", "chr", "beg", "end", "strand", *[F.coalesce(m, F.lit(0)).cast("long").alias(m) for m in MEASURES])


def summary_genome(haplotypes: DataFrame, sites: DataFrame, stranded: bool = False, check: bool = True, check_ends: bool = False) -> DataFrame:
    """Measures of every covered site: each read's whole vector counts at every site that
    it spans.  ``check`` raises ValueError if a haplotype does not begin on a site,
    ``check_ends`` if the last site that it walks is not its end (unless it runs past its
    chromosome's last site)."""
    ranked = sites if "rk" in sites.columns else rank_sites(sites)
    if check:
        bad = missing_starts(haplotypes, ranked).limit(3).collect()
        if bad:
            raise ValueError(f"haplotypes that do not begin on a site: {[tuple(r) for r in bad]}")
    if check_ends:
        bad = wrong_ends(haplotypes, ranked).limit(3).collect()
        if bad:
            raise ValueError(f"haplotypes that do not end on the last site that they walk: {[tuple(r) for r in bad]}")
    table = check_strand(haplotypes) if stranded else haplotypes
    start = ranked.select(F.col("chr").alias("_s_chr"), F.col("pos").alias("_s_pos"), F.col("rk").alias("_s_rk"))
    # equal haplotypes add up before they are dealt to sites
    strand = F.col("strand") if stranded else F.lit("*")
    packed = read_measures(table).withColumn("_n", F.length("hap")).groupBy("chr", "beg", "_n", strand.alias("strand")).agg(*_sums())
    at = packed.join(start, (F.col("chr") == F.col("_s_chr")) & (F.col("beg") == F.col("_s_pos")))
    dealt = at.where("_n > 0").withColumn("_rk", F.explode(F.sequence(F.col("_s_rk"), F.col("_s_rk") + F.col("_n") - 1)))
    by_rank = dealt.groupBy("chr", "_rk", "strand").agg(*_sums())
    here = ranked.select(F.col("chr").alias("_h_chr"), F.col("rk").alias("_h_rk"), F.col("pos"))
    out = by_rank.join(here, (F.col("chr") == F.col("_h_chr")) & (F.col("_rk") == F.col("_h_rk")))
    some = F.greatest("nReads", "mBase", "tBase", "cBase", "K4plus", "nDR") > 0
    return out.where(some).select("chr", "pos", (F.col("pos") + 1).alias("end"), "strand", *MEASURES)
