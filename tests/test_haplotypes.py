import random
from collections import Counter

import pytest

from strandloom.operators import beta as B
from strandloom.operators import haplotypes as H
from strandloom.operators import summary as M
from strandloom.operators.sites import check_sites, rank_sites

HAP = "chr string, beg bigint, end bigint, hap string, cnt int, strand string"


def haps(spark, rows):
    return spark.createDataFrame(rows, HAP)


def sites(spark, positions=(100, 138, 175, 210), chr="chr1"):
    return spark.createDataFrame([(chr, p) for p in positions], "chr string, pos bigint")


def test_merge_modes(spark):
    a = haps(spark, [("c", 1, 9, "01", 1, "+"), ("c", 1, 9, "01", 2, "+")])
    b = haps(spark, [("c", 1, 9, "01", 1, "-"), ("c", 1, 9, "01", 2, "-")])
    grouped = sorted(map(tuple, H.merge(a, b).collect()))
    assert grouped == [("c", 1, 9, "01", 3, "+"), ("c", 1, 9, "01", 3, "-")]
    # the count sorts before the strand, so the strands alternate and nothing is adjacent
    adjacent = sorted(map(tuple, H.merge(a, b, mode="adjacent").collect()))
    assert adjacent == [("c", 1, 9, "01", 1, "+"), ("c", 1, 9, "01", 1, "-"), ("c", 1, 9, "01", 2, "+"), ("c", 1, 9, "01", 2, "-")]


def test_merge_adjacent_loses_equal_lines(spark):
    a = haps(spark, [("c", 1, 9, "01", 1, "+"), ("c", 1, 9, "01", 1, "+"), ("c", 1, 9, "01", 2, "+")])
    b = haps(spark, [("c", 1, 9, "01", 1, "-")])
    # order: 1+ 1+ 1- 2+ -> runs of 2, 1, 2; the two rows (2, +) are equal and one is dropped
    assert sorted(map(tuple, H.merge(a, b, mode="adjacent").collect())) == [("c", 1, 9, "01", 1, "-"), ("c", 1, 9, "01", 2, "+")]


def test_merge_preserves_counts_at_random(spark):
    rng = random.Random(4)
    rows = [("c", 1, 9, rng.choice(["00", "01", "11"]), rng.randint(1, 5), rng.choice("+-")) for _ in range(200)]
    merged = H.merge(haps(spark, rows[:90]), haps(spark, rows[90:])).collect()
    want = Counter()
    for c, b, e, h, n, s in rows:
        want[h, s] += n
    assert {(r.hap, r.strand): r.cnt for r in merged} == dict(want)


def test_merge_checks_inputs(spark):
    with pytest.raises(ValueError):
        H.merge(haps(spark, []))
    with pytest.raises(ValueError):
        H.merge(haps(spark, []), haps(spark, []), mode="other")


def test_beta_sites_and_percent_truncates(spark):
    table = haps(spark, [("chr1", 100, 175, "011", 2, "+"), ("chr1", 100, 175, "011", 1, "-"), ("chr1", 138, 138, "0", 4, "*")])
    got = {r.pos: (r.pct, r.meth, r.unmeth) for r in B.beta(table, sites(spark)).collect()}
    assert got == {100: (0, 0, 3), 138: (42, 3, 4), 175: (100, 3, 0)}


def test_haplotype_longer_or_shorter_than_its_sites(spark):
    table = haps(spark, [("chr1", 100, 138, "0111", 1, "+"), ("chr1", 100, 210, "10", 1, "+")])
    got = {r.pos: (r.meth, r.unmeth) for r in B.beta(table, sites(spark)).collect()}
    assert got == {100: (1, 1), 138: (1, 1)}
    ranged = {r.pos: (r.meth, r.total - r.meth) for r in B.site_sums_by_range(table, sites(spark)).collect()}
    assert ranged == got


def test_beta_regions_edges(spark):
    table = haps(spark, [("chr1", 100, 210, "0110", 1, "+")])
    bed = spark.createDataFrame([("chr1", 100, 138), ("chr1", 101, 137), ("chr1", 9000, 9010), ("chrX", 1, 5)], "chr string, beg bigint, end bigint")
    got = {(r.chr, r.beg): (r.pct, r.meth, r.unmeth) for r in B.beta(table, sites(spark), bed).collect()}
    assert got == {("chr1", 100): (50, 1, 1), ("chr1", 101): (0, 0, 0), ("chr1", 9000): (0, 0, 0), ("chrX", 1): (0, 0, 0)}
    old = {(r.chr, r.beg): (r.pct, r.meth, r.unmeth) for r in B.beta(table, sites(spark), bed, compat=True).collect()}
    assert old[("chr1", 9000)] == (0, 0, 1)  # the last site, 210, is reported


def test_stranded_beta(spark):
    table = haps(spark, [("chr1", 100, 138, "01", 1, "+"), ("chr1", 138, 138, "0", 3, "-")])
    got = {(r.pos, r.strand): r.meth for r in B.beta(table, sites(spark), stranded=True).collect()}
    assert got == {(100, "+"): 0, (138, "+"): 1, (138, "-"): 0}
    with pytest.raises(Exception, match="strand is not"):
        B.beta(haps(spark, [("chr1", 100, 100, "1", 1, "*")]), sites(spark), stranded=True).collect()


def test_alphabet_is_checked(spark):
    with pytest.raises(Exception, match="not of 0 and 1"):
        B.beta(haps(spark, [("chr1", 100, 100, "2", 1, "+")]), sites(spark)).collect()


def test_summary_measures(spark):
    table = haps(spark, [("chr1", 100, 210, "0000", 2, "+"), ("chr1", 100, 210, "0101", 3, "-"), ("chr1", 100, 210, "1111", 1, "+"), ("chr1", 100, 175, "010", 5, "+")])
    regions = spark.createDataFrame([(0, "chr1", 205, 300), (1, "chr1", 211, 300), (2, "chr9", 1, 2)], "ord bigint, chr string, beg bigint, end bigint")
    got = {r.ord: tuple(r[m] for m in M.MEASURES) for r in M.summary_regions(table, regions).collect()}
    assert got == {0: (6, 10, 24, 6, 6, 3, 4), 1: (0,) * 7, 2: (0,) * 7}
    both = {(r.ord, r.strand): r.nReads for r in M.summary_regions(table, regions, stranded=True).collect()}
    assert both[(0, "+")] == 3 and both[(0, "-")] == 3 and both[(2, "-")] == 0
    genome = {r.pos: (r.nReads, r.tBase) for r in M.summary_genome(table, sites(spark)).collect()}
    assert genome == {100: (11, 39), 138: (11, 39), 175: (11, 39), 210: (6, 24)}


def test_summary_invariants(spark):
    rng = random.Random(8)
    rows = [("chr1", 100, 210, "".join(rng.choices("01", k=rng.randint(1, 4))), rng.randint(1, 9), "+") for _ in range(100)]
    for r in M.summary_genome(haps(spark, rows), sites(spark)).collect():
        assert r.nDR <= r.nMR <= r.K4plus <= r.nReads and r.mBase + r.cBase <= r.tBase


def test_genome_needs_sites(spark):
    with pytest.raises(ValueError, match="begin on a site"):
        M.summary_genome(haps(spark, [("chr1", 101, 138, "11", 1, "+")]), sites(spark))


def test_genome_needs_ends(spark):
    right = [("chr1", 100, 138, "11", 1, "+"), ("chr1", 175, 999, "0110", 1, "-"), ("chr1", 210, 210, "1", 1, "+")]  # the second runs past the last site
    assert M.summary_genome(haps(spark, right), sites(spark), check_ends=True).count() == 4
    for wrong in (("chr1", 100, 175, "11", 1, "+"), ("chr1", 138, 139, "0", 2, "-")):
        with pytest.raises(ValueError, match="do not end"):
            M.summary_genome(haps(spark, [*right, wrong]), sites(spark), check_ends=True)


def test_queries_check_their_haplotypes(spark, monkeypatch):
    from strandloom.plans import catalogue

    for stray in (("chr1", 101, 138, "11", 1, "+"), ("chr1", 100, 175, "11", 1, "+")):
        monkeypatch.setattr(catalogue.D, "haplotypes", lambda *_, stray=stray: haps(spark, [stray]))
        monkeypatch.setattr(catalogue.D, "sites", lambda *_: rank_sites(sites(spark)))
        for name in ("summary_genome", "summary_genome_stranded"):
            with pytest.raises(ValueError, match="do not"):
                catalogue.queries()[name](spark, "")


def test_ranks_over_many_bins(spark):
    positions = [5, 1 << 20, (1 << 20) + 1, 3 << 20, 9 << 20]
    got = {r.pos: r.rk for r in rank_sites(sites(spark, positions)).collect()}
    assert got == {p: i for i, p in enumerate(positions)}


def test_duplicate_sites_are_refused(spark):
    with pytest.raises(ValueError):
        check_sites(sites(spark, (5, 5)))
