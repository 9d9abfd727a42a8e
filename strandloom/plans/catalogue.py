"""Queries over the derived tables, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alignment as A
from ..functions import reads as RD
from ..functions.regions import parse_regions
from ..functions.statistics import fisher_exact
from ..operators import beta as B
from ..operators import convert as C
from ..operators import haplotypes as H
from ..operators import likelihood as L
from ..operators import pileup as P
from ..operators import realign as N
from ..operators import regions as R
from ..operators import sites as S
from ..operators import summary as M
from ..operators import synchronized as Y
from ..operators import variants as V
from ..sources import bam, sequences
from ..sources.scratch import scratch_path
from . import derived as D
from . import round_trips
from .oracles import ORACLES

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _QUERIES[f.__name__] = f
    return f


@query
def beta_sites(spark, d):
    return B.beta(D.haplotypes(spark, d), D.sites(spark, d))


@query
def beta_sites_range(spark, d):
    return B.site_sums_by_range(D.haplotypes(spark, d), D.raw_sites(spark, d))


@query
def beta_sites_stranded(spark, d):
    return B.beta(D.haplotypes(spark, d), D.sites(spark, d), stranded=True)


@query
def beta_regions(spark, d):
    return B.beta(D.haplotypes(spark, d), D.sites(spark, d), D.bed(spark, d))


@query
def beta_regions_compat(spark, d):
    return B.beta(D.haplotypes(spark, d), D.sites(spark, d), D.bed(spark, d), compat=True)


@query
def beta_regions_stranded(spark, d):
    return B.beta(D.haplotypes(spark, d), D.sites(spark, d), D.bed(spark, d), stranded=True)


@query
def summary_regions(spark, d):
    return M.summary_regions(D.haplotypes(spark, d), R.bed_to_closed(D.bed(spark, d)))


@query
def summary_regions_stranded(spark, d):
    return M.summary_regions(D.haplotypes(spark, d), R.bed_to_closed(D.bed(spark, d)), stranded=True)


@query
def summary_genome(spark, d):
    return M.summary_genome(D.haplotypes(spark, d), D.sites(spark, d), check_ends=True)


@query
def summary_genome_stranded(spark, d):
    return M.summary_genome(D.haplotypes(spark, d), D.sites(spark, d), stranded=True, check_ends=True)


@query
def merge_grouped(spark, d):
    return H.merge(D.haplotypes(spark, d, 0), D.haplotypes(spark, d, 1))


@query
def merge_adjacent(spark, d):
    return H.merge(D.haplotypes(spark, d, 0), D.haplotypes(spark, d, 1), mode="adjacent")


@query
def hap_union_all(spark, d):
    return H.union_all(D.haplotypes(spark, d, 0), D.haplotypes(spark, d, 1))


@query
def hap_explode_sites(spark, d):
    bits = H.explode_sites(D.haplotypes(spark, d), D.sites(spark, d))
    return bits.groupBy("chr", "beg", "pos", "bit").agg(F.sum("cnt").cast("long").alias("n"))


@query
def sites_rank(spark, d):
    return S.rank_sites(D.raw_sites(spark, d))


@query
def sites_dedup(spark, d):
    lines = D.table(spark, d, "lineitem").selectExpr("concat('chr', l_partkey % 5) AS chr", f"{D.site_position('l_partkey div 5')} AS pos")
    return S.dedup_sites(lines)


@query
def sites_invalid(spark, d):
    some = D.raw_sites(spark, d)
    return S.invalid_sites(some.unionByName(some.where("pos % 3 = 0"))).select("chr", "pos", "count")


@query
def consistency_antijoin(spark, d):
    moved = D.haplotypes(spark, d).withColumn("beg", F.col("beg") + F.when(F.col("cnt") == 3, 1).otherwise(0))
    return H.missing_starts(moved, D.raw_sites(spark, d))


@query
def aln_flag_filter(spark, d):
    return D.alignments(spark, d).where(A.usable(F.col("flag"), F.col("seq"))).select("ord", "flag")


@query
def aln_xm_filter(spark, d):
    return D.alignments(spark, d).where(A.passes_bisulfite_qc(F.col("xm"))).select("ord", "xm")


@query
def aln_strand(spark, d):
    reads = D.alignments(spark, d).withColumn("wc", A.strand_code(F.col("flag"))).where("wc IS NOT NULL")
    return reads.select("ord", "flag", A.strand_symbol(F.col("wc")).alias("strand"))


@query
def aln_flag_string(spark, d):
    names = D.alignments(spark, d).select("flag").distinct().withColumn("names", A.flag_string(F.col("flag")))
    return names.withColumn("again", A.flag_number(F.col("names")))


@query
def aln_cigar_lengths(spark, d):
    c = F.col("cigar")
    return D.alignments(spark, d).select("ord", A.query_length(c).alias("qlen"), A.reference_length(c).alias("rlen"), A.end_position(F.col("flag"), F.col("pos"), c).alias("endpos"))


def _bases(spark, d, mode="BS"):
    return C.site_bases(C.accepted_reads(D.alignments(spark, d)), D.raw_sites(spark, d), mode)


@query
def aln_site_join(spark, d):
    return _bases(spark, d).select("ord", "site")


@query
def aln_methylation_bs(spark, d):
    return _bases(spark, d).select("ord", "site", "met", "q")


@query
def aln_methylation_taps(spark, d):
    return _bases(spark, d, "TAPS").select("ord", "site", "met", "q")


@query
def aln_region_select(spark, d):
    return C.select_reads(D.alignments(spark, d), R.bed_to_closed(D.bed(spark, d))).select("ord", "chr", "pos")


@query
def convert_single_end(spark, d):
    return C.convert(D.alignments(spark, d), D.raw_sites(spark, d), paired=False)


@query
def convert_nondirectional(spark, d):
    return C.convert(D.alignments(spark, d), D.raw_sites(spark, d), directional=False, paired=False)


@query
def mate_pair(spark, d):
    return C.pair_mates(C.read_haplotypes(_bases(spark, d))).select("ord", "qname", "pair")


@query
def mate_union_max_quality(spark, d):
    return C.unite_mates(C.pair_mates(C.read_haplotypes(_bases(spark, d))))


@query
def convert_paired(spark, d):
    return C.convert(D.alignments(spark, d), D.raw_sites(spark, d))


@query
def convert_paired_taps(spark, d):
    return C.convert(D.alignments(spark, d), D.raw_sites(spark, d), mode="TAPS")


@query
def convert_regions(spark, d):
    return C.convert(D.alignments(spark, d), D.raw_sites(spark, d), R.bed_to_closed(D.bed(spark, d)))


@query
def mate_evict(spark, d):
    """Numbers of accepted reads, and pairs whose first mate is given up (every 1000, age 100)."""
    numbers = C.global_index(C.accepted_reads(D.alignments(spark, d)).select("ord", "qname", "chr"), "ord")
    names = numbers.groupBy("chr", "qname").agg(F.min("idx").alias("i"), F.max("idx").alias("j"), F.count("*").alias("n")).where("n = 2")
    return names.select("chr", "qname", "i", "j", C.eviction_breaks(F.col("i"), F.col("j"), 1000, 100).alias("broken"))


@query
def mate_evict_all(spark, d):
    """mate_evict for names with any number of accepted reads."""
    numbers = C.global_index(C.accepted_reads(D.alignments(spark, d)).select("ord", "qname", "chr"), "ord")
    return C.mate_meetings(numbers, 1000, 100)


@query
def convert_evicting(spark, d):
    return C.convert(D.alignments(spark, d), D.raw_sites(spark, d), evict=True)


@query
def convert_evicting_far(spark, d):
    """Eviction that matters: mates lie far apart (every 1000, age 100)."""
    return C.convert(D.far_alignments(spark, d), D.raw_sites(spark, d), evict=True, every=1000, age=100)


@query
def mate_evict_far(spark, d):
    """Every meeting of mates that lie far apart, and whether the first was given up before."""
    numbers = C.global_index(C.accepted_reads(D.far_alignments(spark, d)).select("ord", "qname", "chr"), "ord")
    return C.mate_meetings(numbers, 1000, 100)


@query
def region_parse(spark, d):
    names = [f"chr{i}" for i in range(5)]
    return D.region_strings(spark, d).select("id", "region", parse_regions(F.col("region"), names).alias("r")).select("id", "region", "r.*")


@query
def bed_normalise(spark, d):
    return R.bed_to_closed(D.bed(spark, d))


@query
def region_overlap_semi(spark, d):
    return R.overlap_semi(D.haplotypes(spark, d), R.bed_to_closed(D.bed(spark, d)))


@query
def region_missed_anti(spark, d):
    return R.missed_regions(R.bed_to_closed(D.bed(spark, d)), D.haplotypes(spark, d))


@query
def region_compact(spark, d):
    return R.compact(R.bed_to_closed(D.bed(spark, d)))


@query
def depth_pileup(spark, d):
    return P.depth(D.alignments(spark, d))


@query
def pileup_bases(spark, d):
    return P.aligned_positions(D.alignments(spark, d)).groupBy("chr", "position", "kind").agg(F.count("*").alias("n"))


@query
def index_stats(spark, d):
    return P.index_statistics(D.alignments(spark, d))


@query
def overlap_quality(spark, d):
    bases = _bases(spark, d).select("chr", "qname", F.col("site").alias("position"), "ord", F.coalesce("met", F.lit("?")).alias("base"), "q")
    return P.reconcile_overlap(bases)


@query
def variant_type(spark, d):
    kind = V.variant_type(F.col("ref"), F.col("alt"))
    return D.variants(spark, d).select("id", "ref", "alt", kind["type"].alias("type"), kind["n"].alias("n"))


@query
def variant_is_snp(spark, d):
    return D.variants(spark, d).select("id", V.is_snp(F.col("ref"), F.array("alt")).alias("snp"))


@query
def genotype_class(spark, d):
    kind = V.genotype_class(V.parse_genotype(F.col("gt")))
    return D.genotypes(spark, d).groupBy("gt", kind.alias("class")).agg(F.count("*").alias("n"))


@query
def allele_count(spark, d):
    return V.allele_counts(D.genotypes(spark, d).select("variant", V.parse_genotype(F.col("gt")).alias("alleles")))


@query
def variant_synchronized(spark, d):
    """Two tables that share a third of their records: all but every first, all but every second."""
    table = D.variants(spark, d)
    return V.synchronized(table.where("id % 3 <> 0").select("chr", "pos", "ref", "alt"), table.where("id % 3 <> 1").select("chr", "pos", "ref", "alt"))


@query
def variant_synchronized_many(spark, d):
    """Three tables with several records a position, joined by equal alleles."""
    table = D.variants(spark, d).select("id", "chr", (F.floor(F.col("pos") / 111) * 111).alias("pos"), "ref", F.array("alt").alias("alts"))
    met = Y.synchronize([table.where(f"id % 4 <> {k}") for k in range(3)])
    one = lambda i, c: F.col("records")[i][c]
    return met.select("chr", "pos", *[x for i in range(3) for x in (one(i, "ref").alias(f"ref{i}"), F.array_join(one(i, "alts"), ",").alias(f"alt{i}"))])


@query
def variant_targets_by_alleles(spark, d):
    """Records at targets of their sort: every fifth position asks for indels, the next for the rest."""
    table = D.variants(spark, d).select("id", "chr", "pos", "ref", F.array("alt").alias("alts"))
    alleles = F.when(F.col("id") % 5 == 0, F.array(F.lit("A"), F.lit("AC"))).otherwise(F.array(F.lit("A"), F.lit("C")))
    return Y.targets_by_alleles(table, D.variants(spark, d).where("id % 5 < 2").select("chr", "pos", alleles.alias("alleles"))).select("id", "chr", "pos")


@query
def fisher_exact_strands(spark, d):
    """Strand bias of methylation at every site, by Fisher's exact test."""
    sums = B.site_sums(D.haplotypes(spark, d), D.sites(spark, d), stranded=True)
    side = lambda s, c: F.coalesce(F.sum(F.when(F.col("strand") == s, F.col(c))), F.lit(0))
    both = sums.groupBy("chr", "pos").agg(side("+", "meth").alias("a"), side("+", "total").alias("b"), side("-", "meth").alias("c"), side("-", "total").alias("e"))
    return both.withColumn("t", fisher_exact("a", F.col("b") - F.col("a"), "c", F.col("e") - F.col("c"))).select("chr", "pos", F.round("t.p_two", 6).alias("p_two"))


@query
def aln_insertions(spark, d):
    found = RD.insertions(F.col("pos"), F.col("cigar"), F.col("seq"))
    return D.alignments(spark, d).select("ord", F.explode(found).alias("i")).select("ord", "i.position", "i.bases")


@query
def aln_mapq_cap(spark, d):
    reads = D.alignments(spark, d).select("ord", "cigar", "seq", "qual").withColumn("reference", F.repeat(F.lit("CT"), 60))
    return RD.cap_mapping_quality(reads).select("ord", "cap")


@query
def aln_alignment_quality(spark, d):
    """What the base qualities lose by probabilistic alignment to a reference of CTCT...; no SQL
    twin: the tests compare the model with a sum over all its paths."""
    start = F.greatest(F.floor((F.col("pos") - 200) / 2) * 2, F.lit(0))
    # the model takes far more time than a shuffle, and the table may be one split
    spread = D.alignments(spark, d).select("ord", "flag", "pos", "cigar", "seq", "qual").repartition(4 * spark.sparkContext.defaultParallelism)
    reads = spread.withColumns({"aux": F.expr("cast(map() as map<string,string>)"), "reference_start": start, "reference": F.repeat(F.lit("CT"), 400)})
    return N.base_alignment_quality(reads).select("ord", F.element_at("aux", "BQ").alias("bq"))


@query
def genotype_likelihood(spark, d):
    """The ten genotypes at every site that reads cover, from all their bases there."""
    at_sites = P.bases_at(D.alignments(spark, d), D.raw_sites(spark, d))
    column = at_sites.select("chr", "position", "base", (F.col("ord") % 40 + 2).cast("int").alias("q"), (F.col("ord") % 2 == 1).alias("reverse"))
    return L.genotype_likelihoods(column).select("chr", "position", "depth", "genotype", F.round("phred", 4).alias("phred"))


@query
def variant_remove_alleles(spark, d):
    """Three alternates by record, the second dropped where the id is even."""
    keep = F.when(F.col("id") % 2 == 0, F.array(F.lit(1), F.lit(3))).otherwise(F.array(F.lit(1), F.lit(2), F.lit(3)))
    rows = D.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array(F.lit("C"), F.lit("G"), F.lit("T")).alias("alts"))
    at = lambda n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.col("id") + i)
    cut = rows.select("id", V.keep_alleles(F.lit("A"), F.col("alts"), keep).alias("alts"), *[V.remap_numbers(at(n), k, keep).alias(k.lower()) for k, n in (("A", 3), ("R", 4), ("G", 10))])
    return cut.select("id", *[F.array_join(c, ",").alias(c) for c in ("alts", "a", "r", "g")])


@query
def variant_targets(spark, d):
    return V.targets(D.variants(spark, d), R.bed_to_closed(D.bed(spark, d))).select("id", "chr", "pos")


@query
def variant_targets_excluded(spark, d):
    return V.targets(D.variants(spark, d), R.bed_to_closed(D.bed(spark, d)), exclude=True).select("id", "chr", "pos")


@query
def list_chromosomes(spark, d):
    return D.haplotypes(spark, d).select("chr").distinct()


@query
def text_utilities(spark, d):
    name = F.col("p_name")
    return D.table(spark, d, "part").select("p_partkey", F.md5(name).alias("md5"), F.split(name, " ")[0].alias("word"), RD.percent_decode(F.replace(name, F.lit(" "), F.lit("%20"))).alias("decoded"), RD.base64_decode(F.base64(name.cast("binary"))).alias("again"))


@query
def bam_folder_reads(spark, d):
    """The alignments written as a folder of BAM files and read back in small splits."""
    path = scratch_path(spark, "bam")
    lengths = "@HD\tVN:1.6\n" + "".join(f"@SQ\tSN:chr{i}\tLN:1000000\n" for i in range(5))
    empty = F.expr("cast(map() as map<string,string>)")
    mate = {"mchr": F.lit("*"), "mpos": F.lit(-1).cast("bigint"), "tlen": F.lit(0).cast("bigint"), "aux": empty}
    bam.write_bam(D.alignments(spark, d).withColumns(mate), path, lengths)
    return bam.read_bam(spark, path, split_bytes=1 << 20).select("qname", "flag", "chr", "pos", "mapq", "cigar", "seq", "qual")


@query
def fastq_records(spark, d):
    """The alignments' bases written as FASTQ and read back."""
    path = scratch_path(spark, "fastq")
    qual = F.when(F.col("qual") == "*", F.repeat(F.lit("I"), F.length("seq"))).otherwise(F.col("qual"))
    D.alignments(spark, d).select(F.concat_ws("\n", F.concat(F.lit("@"), "ord"), "seq", F.lit("+"), qual).alias("value")).write.text(path)
    return sequences.read_fastq(spark, path).select("name", "seq", "qual")


@query
def streamed_event_haplotypes(spark, d):
    """The stream's counts over the events table, run until it has read all of it."""
    from ..streaming.counts import counts_until_done

    return counts_until_done(spark, f"{d}/events.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES | round_trips.queries()


def oracle_sql() -> dict[str, str]:
    return ORACLES | round_trips.oracle_sql()
