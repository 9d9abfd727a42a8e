"""Alignments to haplotypes: site join, base decoding, mate pairing and counting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alignment import methylation, passes_bisulfite_qc, quality_at, strand_code, strand_symbol, usable
from .interval_join import overlapping, point_in_interval
from .regions import merged_with_previous

#: Accepted reads between two evictions, and the age at which a waiting mate is given up.
EVICT_EVERY, EVICT_AGE = 50_000, 5_000
INDEX_BUCKET = 1 << 16


def accepted_reads(alignments: DataFrame, directional: bool = True) -> DataFrame:
    """Usable reads with ``wc`` (0 unknown, 1 plus, 2 minus)."""
    reads = alignments.where(usable(F.col("flag"), F.col("seq")))
    if "xm" in alignments.columns:
        kind = F.col("xm_type") if "xm_type" in alignments.columns else None
        reads = reads.where(passes_bisulfite_qc(F.col("xm"), kind))
    return reads.withColumn("wc", strand_code(F.col("flag"), directional)).where(F.col("wc").isNotNull())


def select_reads(alignments: DataFrame, regions: DataFrame) -> DataFrame:
    """Reads that overlap any region (chr, beg, end; 1-based, closed), each once, whole.

    Regions are merged first, so however many cover a place, a read meets only those it reaches
    of the merged ones, and is taken at the first of them: the merged region before that one ends
    in front of the read.
    """
    spans = alignments.withColumns({"_a_beg": F.col("pos") + 1, "_a_end": F.col("pos") + F.greatest(F.length("seq"), F.lit(1))})
    wanted = merged_with_previous(regions.where("beg <= end")).select(F.col("chr").alias("_r_chr"), F.col("beg").alias("_r_beg"), F.col("end").alias("_r_end"), F.col("previous").alias("_r_previous"))
    met = overlapping(spans, wanted, "chr", "_a_beg", "_a_end", "_r_chr", "_r_beg", "_r_end")
    return met.where(F.col("_r_previous").isNull() | (F.col("_r_previous") < F.col("_a_beg"))).select(*alignments.columns)


def site_bases(reads: DataFrame, sites: DataFrame, mode: str = "BS", width: int = 256) -> DataFrame:
    """ord, chr, qname, wc, site, met (null if illegal) and q for every site under a read.

    A minus read shows a site's second base, one position on; CIGAR is not considered.
    """
    n = F.length("seq")
    minus = F.col("wc") == 2
    lo = F.col("pos") + F.when(minus, 0).otherwise(1)
    spans = reads.withColumns({"_lo": lo, "_hi": lo + n - 1})
    points = sites.select(F.col("chr").alias("_p_chr"), F.col("pos").alias("site"))
    met = point_in_interval(spans, points, "chr", F.col("_lo"), F.col("_hi"), "_p_chr", "site", width)
    offset = (F.col("site") - F.col("_lo")).cast("int")
    base = F.substr(F.col("seq"), offset + 1, F.lit(1))
    return met.select("ord", *_numbered(reads), "chr", "qname", "wc", "site", methylation(base, F.col("wc"), mode).alias("met"), quality_at(F.col("qual"), offset).alias("q"))


def _numbered(reads: DataFrame) -> list[str]:
    return ["idx"] if "idx" in reads.columns else []


def read_haplotypes(bases: DataFrame) -> DataFrame:
    """One row a read whose bases are legal at all its sites: its calls in site order (and its
    number ``idx``, if the bases have it)."""
    calls = F.array_sort(F.collect_list(F.struct("site", "met", "q")))
    whole = bases.groupBy("ord", *_numbered(bases), "chr", "qname", "wc").agg(calls.alias("calls"), F.bool_and(F.col("met").isNotNull()).alias("legal"))
    return whole.where("legal").select("ord", *_numbered(bases), "chr", "qname", "wc", "calls", F.col("calls")[0]["site"].alias("s0"), F.element_at("calls", -1)["site"].alias("e0"))


def global_index(df: DataFrame, order: str) -> DataFrame:
    """Add ``idx``, the 0-based place in the order of a whole-number column, without one task
    that sorts everything: rows are ranked in buckets of keys, the buckets' counts are added up
    in stretches of buckets, and the stretches' by one task (a row for each 2^32 keys)."""
    keyed = df.withColumn("_bucket", F.floor(F.col(order) / INDEX_BUCKET))
    sizes = keyed.groupBy("_bucket").count().withColumn("_part", F.floor(F.col("_bucket") / INDEX_BUCKET))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("_part").agg(F.sum("count").alias("count")).select(F.col("_part").alias("_p"), F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_ahead"))
    before = Window.partitionBy("_part").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.withColumn("_inner", F.coalesce(F.sum("count").over(before), F.lit(0))).join(parts, F.col("_part") == F.col("_p"))
    base = base.select(F.col("_bucket").alias("_b"), (F.col("_ahead") + F.col("_inner")).alias("_base"))
    inner = keyed.withColumn("_rn", F.row_number().over(Window.partitionBy("_bucket").orderBy(order)) - 1)
    return inner.join(base, F.col("_bucket") == F.col("_b")).select(*df.columns, (F.col("_rn") + F.col("_base")).cast("long").alias("idx"))


def eviction_breaks(first: F.Column, second: F.Column, every: int = EVICT_EVERY, age: int = EVICT_AGE) -> F.Column:
    """Whether the mate with accepted number ``first`` was given up before ``second`` came."""
    return F.ceil((first + age + 1) / every) * every <= second + 1


def pair_mates(haplotypes: DataFrame, numbers: DataFrame | None = None, every: int = EVICT_EVERY, age: int = EVICT_AGE) -> DataFrame:
    """Add ``pair``: successive reads of one name on a chromosome share a number.

    With ``numbers`` (ord, idx of accepted reads), or a column ``idx``, waiting mates are given up
    as the bounded buffer does.  A read that would be given up before the next one of its name
    comes ends a stretch of reads; whether it waits then or has met its mate, the next one starts
    afresh, so reads pair off from the start of each stretch.
    """
    order = Window.partitionBy("chr", "qname").orderBy("ord")
    if numbers is None and "idx" not in haplotypes.columns:
        rn = haplotypes.withColumn("_rn", F.row_number().over(order))
        return rn.withColumn("pair", F.floor((F.col("_rn") - 1) / 2).cast("long")).drop("_rn")
    seen, idx = haplotypes, "idx"
    if numbers is not None:
        seen, idx = haplotypes.join(numbers.select(F.col("ord").alias("_n_ord"), F.col("idx").alias("_idx")), F.col("ord") == F.col("_n_ord")).drop("_n_ord"), "_idx"
    broken = F.coalesce(eviction_breaks(F.lag(idx).over(order), F.col(idx), every, age), F.lit(False))
    cut = seen.withColumn("_broken", broken.cast("int")).withColumn("_stretch", F.sum("_broken").over(order))
    turn = F.row_number().over(Window.partitionBy("chr", "qname", "_stretch").orderBy("ord"))
    halved = cut.withColumn("_half", F.floor((turn - 1) / 2))
    number = F.dense_rank().over(Window.partitionBy("chr", "qname").orderBy("_stretch", "_half")) - 1
    return halved.withColumn("pair", number.cast("long")).select(*haplotypes.columns, "pair")


def mate_meetings(numbers: DataFrame, every: int = EVICT_EVERY, age: int = EVICT_AGE) -> DataFrame:
    """chr, qname, i, j and ``broken`` for every accepted read (ord, chr, qname, idx) that comes
    when one of its name has waited: i waits, j comes, and broken tells whether i was given up
    before, so that j waits in its place.  Names have any number of reads."""
    paired = pair_mates(numbers.select("ord", "chr", "qname"), numbers, every, age).join(numbers.select(F.col("ord").alias("_o"), "idx"), F.col("ord") == F.col("_o"))
    sized = paired.withColumn("_size", F.count("*").over(Window.partitionBy("chr", "qname", "pair")))
    order = Window.partitionBy("chr", "qname").orderBy("ord")
    before = sized.withColumns({"i": F.lag("idx").over(order), "_pair": F.lag("pair").over(order), "_alone": F.lag("_size").over(order) == 1})
    return before.where((F.col("pair") == F.col("_pair")) | F.col("_alone")).select("chr", "qname", "i", F.col("idx").alias("j"), (F.col("pair") != F.col("_pair")).alias("broken"))


def unite_mates(paired: DataFrame) -> DataFrame:
    """Haplotype instances: mates whose site spans overlap become one, each site taking the
    call of the better quality (ties: the first mate's); others stay as they are."""
    reads = F.array_sort(F.collect_list(F.struct("ord", "wc", "s0", "e0", "calls")))
    groups = paired.groupBy("chr", "qname", "pair").agg(reads.alias("reads"))
    one, two = F.col("reads")[0], F.get("reads", F.lit(1))
    united = (F.size("reads") == 2) & (F.greatest(one["s0"], two["s0"]) <= F.least(one["e0"], two["e0"]))
    ranked = lambda r, at: F.transform(r["calls"], lambda c: F.struct(c["site"].alias("site"), (-c["q"]).alias("worse"), F.lit(at).alias("mate"), c["met"].alias("met")))
    every = F.array_sort(F.concat(ranked(one, 0), ranked(two, 1)))
    best = F.filter(every, lambda c, i: (i == 0) | (F.get(every, i - 1)["site"] != c["site"]))
    plain = lambda r: F.struct(r["wc"].alias("wc"), F.transform(r["calls"], lambda c: F.struct(c["site"].alias("site"), c["met"].alias("met"))).alias("calls"))
    merged = F.struct(one["wc"].alias("wc"), F.transform(best, lambda c: F.struct(c["site"].alias("site"), c["met"].alias("met"))).alias("calls"))
    out = groups.withColumn("h", F.explode(F.when(united, F.array(merged)).otherwise(F.transform("reads", plain))))
    calls = F.col("h.calls")
    return out.select(
        "chr", calls[0]["site"].alias("beg"), F.element_at(calls, -1)["site"].alias("end"), F.array_join(F.transform(calls, lambda c: c["met"]), "").alias("hap"), strand_symbol(F.col("h.wc")).alias("strand")
    )


def count_haplotypes(instances: DataFrame) -> DataFrame:
    return instances.groupBy("chr", "beg", "end", "hap", "strand").agg(F.count("*").alias("cnt")).select("chr", "beg", "end", "hap", "cnt", "strand")


def convert(alignments: DataFrame, sites: DataFrame, regions: DataFrame | None = None, directional: bool = True, mode: str = "BS", paired: bool = True, evict: bool = False, every: int = EVICT_EVERY, age: int = EVICT_AGE) -> DataFrame:
    """Haplotype counts of alignments (ord, qname, flag, chr, pos, seq, qual, optional xm).

    ``regions`` choose reads but do not clip haplotypes.  ``paired`` unites overlapping mates;
    ``evict`` also gives up waiting mates as the historic bounded buffer did.
    """
    if mode not in ("BS", "TAPS"):
        raise ValueError(f"mode must be BS or TAPS, not {mode!r}")
    reads = accepted_reads(alignments if regions is None else select_reads(alignments, regions), directional)
    if paired and evict:
        reads = global_index(reads, "ord")
    haplotypes = read_haplotypes(site_bases(reads, sites, mode))
    if not paired:
        met = F.transform("calls", lambda c: c["met"])
        return count_haplotypes(haplotypes.select("chr", F.col("s0").alias("beg"), F.col("e0").alias("end"), F.array_join(met, "").alias("hap"), strand_symbol(F.col("wc")).alias("strand")))
    return count_haplotypes(unite_mates(pair_mates(haplotypes, None, every, age)))
