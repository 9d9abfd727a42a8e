import functools
import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from strandloom.functions import statistics as ST
from strandloom.functions.regions import POS_MAX, parse_decimal, parse_region, parse_summary_region
from strandloom.operators import pileup as P
from strandloom.operators import regions as R
from strandloom.operators import variants as V

NAMES = ["chr1", "chr1:100", "chr1:100-200", "chr2:100-200", "chr3", "chr1,chr3"]
GRAMMAR = [
    ("chr1", {}, ("chr1", 0, POS_MAX, "")), ("chr1:50", {}, ("chr1", 49, POS_MAX, "")), ("chr1:50", {"one_coord": True}, ("chr1", 49, 50, "")), ("chr1:50-100", {}, ("chr1", 49, 100, "")),
    ("chr1:50-", {}, ("chr1", 49, POS_MAX, "")), ("chr1:-50", {}, ("chr1", 0, 50, "")), ("chr1:100-200", {}, None), ("{chr1}:100-200", {}, ("chr1", 99, 200, "")),
    ("{chr1:100-200}", {}, ("chr1:100-200", 0, POS_MAX, "")), ("{chr1:100-200}:100-200", {}, ("chr1:100-200", 99, 200, "")), ("{chr2:100-200}:100-200", {}, ("chr2:100-200", 99, 200, "")),
    ("chr2:100-200:100-200", {}, ("chr2:100-200", 99, 200, "")), ("chr2:100-200", {}, ("chr2:100-200", 0, POS_MAX, "")), ("chr3", {}, ("chr3", 0, POS_MAX, "")), ("chr3:", {}, ("chr3", 0, POS_MAX, "")),
    ("chr3:1000-1500", {}, ("chr3", 999, 1500, "")), ("chr3:1,000-1,500", {}, ("chr3", 999, 1500, "")), ("chr3:1k-1.5K", {}, ("chr3", 999, 1500, "")), ("chr3:1e3-1.5e3", {}, ("chr3", 999, 1500, "")),
    ("chr3:1e3-15e2", {}, ("chr3", 999, 1500, "")), ("chr1,chr3", {"as_list": True}, ("chr1", 0, POS_MAX, "chr3")), ("chr1:100-200,chr3", {"as_list": True}, None),
    ("{chr1,chr3}", {"as_list": True}, ("chr1,chr3", 0, POS_MAX, "")), ("{chr1,chr3},chr1", {"as_list": True}, ("chr1,chr3", 0, POS_MAX, "chr1")),
    ("chr3:1,000-1,500", {"as_list": True, "one_coord": True}, ("chr3", 0, 1, "000-1,500")), ("chr2", {}, None), ("chr1,", {}, None), ("{chr1", {}, None), ("chr1:10-10", {}, ("chr1", 9, 10, "")),
    ("chr1:10-9", {}, None), ("chr1:x", {}, None), ("chr1:1-y", {}, None), ("chr1:1,chr3", {}, None),
]


@pytest.mark.parametrize("text,options,want", GRAMMAR)
def test_region_grammar(text, options, want):
    if want is None:
        with pytest.raises(ValueError):
            parse_region(text, NAMES, **options)
    else:
        assert parse_region(text, NAMES, **options) == want


def test_decimals_and_summary_regions():
    assert parse_decimal("1,234x") == (1234, "x") and parse_decimal("-1.5k") == (-1500, "") and parse_decimal("2M-") == (2_000_000, "-") and parse_decimal("abc") == (0, "abc")
    assert parse_summary_region("chr1:5-9") == ("chr1", 5, 9)
    for bad in ("chr1", "chr1:5", "chr1:5-"):
        with pytest.raises(ValueError):
            parse_summary_region(bad)


def test_overlaps_at_random(spark):
    rng = random.Random(11)
    make = lambda n: [("c%d" % rng.randint(0, 1), b := rng.randint(0, 5000), b + rng.choice([0, 5, 300, 2500])) for _ in range(n)]
    a, b = make(80), list(dict.fromkeys(make(40)))
    left, right = (spark.createDataFrame(x, "chr string, beg bigint, end bigint") for x in (a, b))
    hit = lambda x, y: x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2]
    assert sorted(map(tuple, R.overlap_semi(left, right).collect())) == sorted(x for x in a if any(hit(x, y) for y in b))
    assert sorted(map(tuple, R.missed_regions(right, left).collect())) == sorted(y for y in b if not any(hit(x, y) for x in a))


def test_compact(spark):
    df = spark.createDataFrame([("c", 1, 5), ("c", 6, 8), ("c", 3, 4), ("c", 10, 12), ("d", 1, 2)], "chr string, beg bigint, end bigint")
    assert sorted(map(tuple, R.compact(df).collect())) == [("c", 1, 8), ("c", 10, 12), ("d", 1, 2)]
    rng = random.Random(6)
    rows = [(f"c{rng.randint(0, 1)}", b := rng.randint(1, 5 << 20), b + rng.choice([3, 400, 90_000, 2 << 20])) for _ in range(60)]
    want = []
    for c, b, e in sorted(rows):
        if want and want[-1][0] == c and b <= want[-1][2] + 1:
            want[-1] = (c, want[-1][1], max(e, want[-1][2]))
        else:
            want.append((c, b, e))
    assert sorted(map(tuple, R.compact(spark.createDataFrame(rows, "chr string, beg bigint, end bigint")).collect())) == want
    assert [r.end for r in R.listed(spark.createDataFrame([("c", 1, 5), ("c", 1, 9)], "chr string, beg bigint, end bigint")).collect()] == [9, 5]


def test_depth_equals_expansion(spark):
    rng = random.Random(2)
    rows = [(i, "q", 0, "c", rng.randint(16_000, 17_000), f"{rng.randint(1, 60)}M2D{rng.randint(1, 9)}M", "A" * 80) for i in range(60)]
    aln = spark.createDataFrame(rows, "ord bigint, qname string, flag int, chr string, pos bigint, cigar string, seq string")
    expanded = {(r.chr, r.position): r["count"] for r in P.aligned_positions(aln).groupBy("chr", "position").count().collect()}
    assert {(r.chr, r.position): r.depth for r in P.depth(aln).collect()} == expanded
    kinds = {r.kind for r in P.aligned_positions(aln).select("kind").distinct().collect()}
    assert kinds == {"M", "D"}


def test_sample_depths(spark):
    aln = spark.createDataFrame([(0, "a", 0, "c", 0, "2M", "AC", "s1"), (1, "b", 0, "c", 1, "2M", "AC", "s2")], "ord bigint, qname string, flag int, chr string, pos bigint, cigar string, seq string, sample string")
    assert sorted(tuple(r) for r in P.sample_depths(aln, "sample", ["s1", "s2"]).collect()) == [("c", 1, 1, 0), ("c", 2, 1, 1), ("c", 3, 0, 1)]


def test_bases_at_sites(spark):
    """As the aligned positions joined with the sites, by every kind of run and over bin borders."""
    rng = random.Random(9)
    cigars = ["40M", "2S30M1I7M", "3M200D37M", "20M30000N20M", "*", "25=15X", "40I", "10M1P30M", "5H3S37M2H", "0M40M"]
    rows = [(i, rng.choice([0, 16, 4, 1024]), rng.choice("cd"), rng.randrange(0, 400), rng.choice(cigars), "".join(rng.choices("ACGTN", k=40))) for i in range(150)]
    aln = spark.createDataFrame(rows, "ord bigint, flag int, chr string, pos bigint, cigar string, seq string")
    sites = spark.createDataFrame([(c, x) for c in "ce" for x in [*range(1, 700, 9), 64, 128, 30100]], "chr string, pos bigint").distinct()
    at = {(r.chr, r.pos) for r in sites.collect()}
    want = []
    for o, flag, c, pos, cigar, seq in rows:
        x, y = pos, 0
        for n, op in re.findall(r"(\d+)([MIDNSHP=X])", "" if flag & 3844 else cigar):
            if op in "M=X":
                want += [(o, c, x + i + 1, seq[y + i]) for i in range(int(n)) if (c, x + i + 1) in at]
            x, y = x + int(n) * (op in "MDN=X"), y + int(n) * (op in "MIS=X")
    for width in (64, 7):
        assert sorted(tuple(r) for r in P.bases_at(aln, sites, width).collect()) == sorted(want) and want


def test_likelihoods_of_a_deep_column(spark):
    """A column of many bases is never expanded to them again: as the sum base by base."""
    from strandloom.operators import likelihood as L

    rng = random.Random(3)
    groups = [(b, q, r, rng.randint(1, 400)) for b in "ACGN" for q in (3, 10, 30, 70) for r in (False, True)]
    rows = [(b, q, r) for b, q, r, m in groups for _ in range(m)]
    got = likelihoods(spark, *zip(*rows))
    n, spent = len(rows), dict.fromkeys("ACGT", 0.0)
    for base in "ACG":
        seen, strand = 0, {True: 0, False: 0}
        for _, q, r, m in sorted((x for x in groups if x[0] == base), key=lambda x: (-x[1], not x[2])):
            costs = L.error_costs(min(63, max(4, q)), n)
            for _ in range(m):
                spent[base] += (0.83 ** strand[r] * 0.97 + 0.03) * costs[seen]
                seen, strand[r] = seen + 1, strand[r] + 1
    assert all(math.isclose(got[b + b], sum(spent.values()) - spent[b], rel_tol=1e-9) for b in "ACGT")
    column = spark.createDataFrame([("c", 1, "A", 30, True)], "chr string, position bigint, base string, q int, reverse boolean")
    assert "explode(sequence" not in L.genotype_likelihoods(column)._jdf.queryExecution().optimizedPlan().toString()


def test_sample_depths_expand_no_read(spark):
    """Against positions counted one by one, with long skips, unnamed samples and cut reads; the
    plan has no row for each base of a read."""
    import io
    from contextlib import redirect_stdout

    rng = random.Random(7)
    cigars = ["4M", "2S3M1I2M", "3M2D3M1H", "2M30000N2M", "*", "5=1X", "3I", "2M1P2M"]
    rows = [(i, rng.choice([0, 16, 4, 1024]), rng.choice("cd"), rng.randrange(16370, 16400), rng.choice(cigars), "ACGTACGT", rng.choice(["s1", "s2", "s3", None])) for i in range(120)]
    aln = spark.createDataFrame(rows, "ord bigint, flag int, chr string, pos bigint, cigar string, seq string, sample string")
    want = {}
    for _, flag, c, pos, cigar, _, s in rows:
        if not flag & 3844 and cigar != "*":
            for x in range(sum(int(n) for n in re.findall(r"(\d+)[MDN=X]", cigar))):
                at = want.setdefault((c, pos + 1 + x), [0, 0])
                if s in ("s1", "s2"):
                    at[s == "s2"] += 1
    found = P.sample_depths(aln, "sample", ["s1", "s2"])
    assert {(r.chr, r.position): [r.s1, r.s2] for r in found.collect()} == want
    with redirect_stdout(io.StringIO()) as plan:
        found.explain()
    assert "Join" not in plan.getvalue()


def test_overlap_qualities(spark):
    df = spark.createDataFrame([("c", "q", 1, 0, "A", 150), ("c", "q", 1, 1, "A", 90), ("c", "q", 2, 0, "A", 10), ("c", "q", 2, 1, "C", 30), ("c", "q", 3, 0, "A", 7)], "chr string, qname string, position bigint, ord bigint, base string, q int")
    got = {(r.position, r.ord): r.q_new for r in P.reconcile_overlap(df).collect()}
    assert got == {(1, 0): 200, (1, 1): 0, (2, 0): 0, (2, 1): 24, (3, 0): 7}


def test_variant_types(spark):
    cases = [("A", "C", 1, 1), ("A", "a", 1, 1), ("A", "A", 0, 0), ("A", ".", 0, 0), ("A", "*", 32, 0), ("A", "<X>", 0, 0), ("A", "<DEL>", 8, 0), ("A", "AT", 4, 1), ("ATG", "A", 4, -2), ("AT", "GC", 2, 2), ("ACT", "AGT", 1, 1), ("A", "A]chr1:5]", 16, 0), ("ACGT", "TT", 8, -2), ("AC", "ACGC", 4, 2), ("ATTC", "AGC", 8, -1)]
    df = spark.createDataFrame([c[:2] for c in cases], "ref string, alt string")
    kind = V.variant_type(df.ref, df.alt)
    assert [(r.ref, r.alt, r.t, r.n) for r in df.select("ref", "alt", kind["type"].alias("t"), kind["n"].alias("n")).collect()] == cases
    both = spark.sql("select 'A' as ref, array('C', 'AT') as alts")
    assert both.select(V.record_type(both.ref, both.alts)).first()[0] == 5
    assert not both.select(V.is_snp(both.ref, both.alts)).first()[0]


def test_synchronized_pairs_equal_alleles_first(spark):
    left = [("c", 1, "A", "C"), ("c", 1, "A", "T"), ("c", 2, "A", "C"), ("c", 2, "A", "G"), ("c", 3, "A", "C"), ("c", 3, "A", "C"), ("c", 4, "A", "AT"), ("c", 5, "A", "C"), ("c", 5, "A", "c"), (None, 6, "A", "C"), ("d", 1, "A", "C"), ("c", 7, "A", None), ("c", 8, "A", "C")]
    right = [("c", 1, "A", "T"), ("c", 2, "A", "T"), ("c", 2, "A", "G"), ("c", 3, "A", "C"), ("c", 4, "A", "C"), ("c", 5, "a", "c"), ("c", 5, "A", "c"), (None, 6, "A", "C"), ("c", 7, "A", None), ("c", 8, "A", "G"), ("c", 8, "A", "T")]
    want = [
        ("c", 1, "A", "C", None, None), ("c", 1, "A", "T", "A", "T"), ("c", 2, "A", "C", "A", "T"), ("c", 2, "A", "G", "A", "G"), ("c", 3, "A", "C", "A", "C"), ("c", 3, "A", "C", None, None),
        ("c", 4, "A", "AT", None, None), ("c", 4, None, None, "A", "C"), ("c", 5, "A", "C", "a", "c"), ("c", 5, "A", "c", "A", "c"), (None, 6, "A", "C", None, None), (None, 6, None, None, "A", "C"),
        ("d", 1, "A", "C", None, None), ("c", 7, "A", None, "A", None), ("c", 8, "A", "C", "A", "G"), ("c", 8, None, None, "A", "T"),
    ]
    tables = [spark.createDataFrame(x, "chr string, pos bigint, ref string, alt string") for x in (left, right)]
    assert sorted(map(tuple, V.synchronized(*tables).collect()), key=str) == sorted(want, key=str)
    assert sorted(map(tuple, V.synchronized(*tables[::-1]).collect()), key=str) == sorted(((c, p, *b, *a) for c, p, *x in want for a, b in [(x[:2], x[2:])]), key=str)


def test_genotypes_and_filters(spark):
    cases = {"0/0": 0, "1|1": 1, "0/2": 2, "1/2": 3, "0": 4, "1": 5, "./1": 6, ".": 6, "0/1/1": 2}
    df = spark.createDataFrame([(k,) for k in cases], "gt string")
    assert {r.gt: r.c for r in df.select("gt", V.genotype_class(V.parse_genotype(df.gt)).alias("c")).collect()} == cases
    f = spark.sql("select array('PASS') as f, array('q10') as g, cast(array() as array<string>) as e")
    row = f.select(V.add_filter(f.f, "q10"), V.add_filter(f.g, "q10"), V.remove_filter(f.g, "q10"), V.has_filter(f.e, F.lit(".")), V.has_filter(f.g, F.lit("PASS"))).first()
    assert tuple(row) == (["q10"], ["q10"], ["PASS"], True, False)


def test_fisher_by_enumeration():
    for table in itertools.product(range(4), repeat=4):
        a, b, c, d = table
        row, col, n = a + b, a + c, sum(table)
        p, left, right, two = ST.fisher(*table)
        lo, hi = max(0, row + col - n), min(row, col)
        if lo == hi:
            assert (p, left, right, two) == (1, 1, 1, 1)
            continue
        each = {k: math.comb(row, k) * math.comb(n - row, col - k) / math.comb(n, col) for k in range(lo, hi + 1)}
        assert math.isclose(p, each[a], rel_tol=1e-9)
        assert math.isclose(left, sum(v for k, v in each.items() if k <= a), rel_tol=1e-9) and math.isclose(right, sum(v for k, v in each.items() if k >= a), rel_tol=1e-9)
        assert math.isclose(two, min(1, sum(v for v in each.values() if v <= each[a] * (1 + 1e-8))), rel_tol=1e-9)


def test_special_functions():
    assert math.isclose(ST._gamma_p(1.0, 2.0), 1 - math.exp(-2)) and math.isclose(ST._gamma_p(1.0, 0.1), 1 - math.exp(-0.1))
    assert math.isclose(ST._beta(2, 3, 0.4), sum(math.comb(4, k) * 0.4**k * 0.6 ** (4 - k) for k in range(2, 5)))


def test_special_functions_at_zero():
    assert ST._gamma_p(0.0, 2.0) == 1.0 and ST._gamma_p(0.0, 0.0) == 0.0


def test_log_factorial(spark):
    got = spark.range(0, 400).select("id", ST.log_factorial("id").alias("f")).collect()
    assert all(math.isclose(r.f, math.lgamma(r.id + 1), rel_tol=1e-13, abs_tol=1e-13) for r in got)


def likelihoods(spark, bases, quals, reverse):
    from strandloom.operators.likelihood import genotype_likelihoods

    rows = [("c", 1, b, q, r) for b, q, r in zip(bases, quals, reverse)]
    found = genotype_likelihoods(spark.createDataFrame(rows, "chr string, position bigint, base string, q int, reverse boolean")).collect()
    return {r.genotype: r.phred for r in found}


def test_likelihood_model(spark):
    from strandloom.operators.likelihood import error_costs

    # the steps are ratios of binomial tails
    steps = error_costs(10, 4)
    tail = [sum(math.comb(4, i) * 0.1**i * 0.9 ** (4 - i) for i in range(k, 5)) for k in range(6)]
    assert all(math.isclose(steps[k], -10 * math.log10(tail[k + 1] / tail[k]), rel_tol=1e-9) for k in range(4))
    same = likelihoods(spark, ["A"] * 8, [30] * 8, [False, True] * 4)
    assert same["AA"] == 0 and same["CC"] > same["AC"] > 0
    mixed = likelihoods(spark, ["A", "C"] * 5, [30] * 10, [False] * 10)
    assert mixed["AC"] == min(mixed.values()) and not likelihoods(spark, [], [], [])
    assert set(likelihoods(spark, ["N", "N"], [30, 2], [True, False]).values()) == {0.0}


def test_likelihood_of_a_column_by_hand(spark):
    """Base by base: the best quality first, at one quality the reverse strand first."""
    rows = [("A", 40, False), ("A", 40, True), ("A", 70, False), ("C", 20, True), ("N", 30, False), ("A", 2, True), ("T", 25, False), ("A", 40, False)]
    clipped = [(b, min(63, max(4, q)), r) for b, q, r in rows]
    tail = lambda q, k: sum(math.comb(8, i) * (e := 10 ** (-q / 10)) ** i * (1 - e) ** (8 - i) for i in range(k, 9))
    cost = {}
    for b in "ACGT":
        own = sorted([x for x in clipped if x[0] == b], key=lambda x: (-x[1], not x[2]))
        strand = {True: 0, False: 0}
        cost[b] = 0.0
        for k, (_, q, r) in enumerate(own):
            cost[b] += (0.83 ** strand[r] * 0.97 + 0.03) * -10 * math.log10(tail(q, k + 1) / tail(q, k))
            strand[r] += 1
    got = likelihoods(spark, *zip(*rows))
    assert math.isclose(got["AA"], cost["C"] + cost["T"], rel_tol=1e-9) and math.isclose(got["GG"], sum(cost.values()), rel_tol=1e-9)
    assert math.isclose(got["AC"], cost["T"] - 4.343 * math.log(math.comb(6, 1) / 2**6), rel_tol=1e-9)


def test_capped_quality(spark):
    from strandloom.functions.reads import cap_mapping_quality

    cases = [
        ("8M", "ACGTACGT", "IIIIIIII", "ACGTACGT"), ("8M", "ACGTACGT", "IIIIIIII", "ACGAACGT"), ("8M", "AAAAAAAA", "IIIIIIII", "CCCCCCCC"), ("8M", "AAAAAAAA", "!!!!!!!!", "CCCCCCCC"),
        ("2S4M2H", "AAACGT", "IIIIII", "ACGT"), ("4M4M", "ACGTAAAA", "IIIIIIII", "ACGTCC"), ("*", "ACGT", "IIII", "ACGT"), ("4M2D4M", "ACGTACGT", "*", "ACGTNN=C=T"), ("2M9D4S", "ACGTAC", "IIIIII", "ACGT"), ("2M9N4M4S", "ACGTACGTAC", "I" * 10, "ACGT"),
    ]
    table = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "ord bigint, cigar string, seq string, qual string, reference string")
    got = [r.cap for r in cap_mapping_quality(table).orderBy("ord").collect()]
    assert got[0] == 40 and 0 < got[1] < 40 and got[2] == -1 and got[3] == 40

    def cap(n, wrong, clipped):
        t = sum(wrong) - 4.343 * (len(wrong) * math.log(n) - math.lgamma(len(wrong) + 1)) + clipped / 5
        return -1 if t > 40 else int(math.sqrt((40 - max(t, 0)) / 40) * 40 + 0.499)

    # lengths of runs that end within the reference and their bases count; of others the bases alone
    assert got[4:] == [cap(8, [], 106), cap(10, [33, 33], 0), 40, cap(14, [33, 33], 0), cap(4, [], 0), cap(4, [], 0)]


def test_columns_of_regions(spark):
    from strandloom.functions.regions import parse_regions

    table = spark.createDataFrame([("c:5-9",), (None,), ("{c}",), ("c:3",)], "t string")
    assert [tuple(r.r) for r in table.select(parse_regions(F.col("t"), ["c"]).alias("r")).collect()] == [("c", 4, 9), (None, None, None), ("c", 0, POS_MAX), ("c", 2, POS_MAX)]


def test_insertions(spark):
    from strandloom.functions.reads import insertions

    df = spark.createDataFrame([(9, "2S3M2I1P1I2M1D1M", "TTACGGGTCAA")], "pos bigint, cigar string, seq string")
    assert [tuple(x) for x in df.select(insertions(df.pos, df.cigar, df.seq)).first()[0]] == [(12, "GG*T")]


def sets_of(records, *pairing):
    """Sets as sorted lists of table:alleles, from records (table, ref, alts)."""
    from strandloom.operators.synchronized import Pairing, pair_position

    def types(ref, alts):
        each = [0 if a == "." else 1 if len(a) == len(ref) == 1 else 4 for a in alts]
        return functools.reduce(lambda x, y: x | y, each, 0)

    found = pair_position([(t, r, a, types(r, a)) for t, r, a in records], Pairing(pairing))
    assert sorted(i for s in found for i in s.values()) == list(range(len(records)))
    return sorted(sorted(f"{t}:{records[i][1]}>{','.join(records[i][2]) or '.'}" for t, i in s.items()) for s in found)


def test_pairing_of_records():
    one, two = (0, "A", ["C"]), (1, "A", ["T"])
    assert sets_of([one, two], "exact") == sets_of([one, two], "some") == [["0:A>C"], ["1:A>T"]]
    assert sets_of([one, two], "snps") == sets_of([one, two], "any") == [["0:A>C", "1:A>T"]]
    multi = (1, "A", ["T", "C"])
    assert sets_of([one, multi], "exact") == [["0:A>C"], ["1:A>T,C"]] and sets_of([one, multi], "some") == [["0:A>C", "1:A>T,C"]]
    assert sets_of([(0, "A", ["C", "T"]), multi], "exact") == [["0:A>C,T", "1:A>T,C"]]
    indel, ref = (1, "A", ["AT"]), (1, "A", [])
    assert sets_of([one, indel], "both") == [["0:A>C"], ["1:A>AT"]] and sets_of([one, indel], "any") == [["0:A>C", "1:A>AT"]]
    assert sets_of([one, ref], "both") == [["0:A>C"], ["1:A>."]] and sets_of([one, ref], "snp_ref") == sets_of([one, ref], "both_ref") == [["0:A>C", "1:A>."]]
    assert sets_of([(0, "A", ["AC"]), ref], "snps", "snp_ref") == [["0:A>AC"], ["1:A>."]] and sets_of([(0, "A", ["AC"]), ref], "indel_ref") == [["0:A>AC", "1:A>."]]
    # the same record first, whatever else may pair
    assert sets_of([(0, "A", ["C"]), (0, "A", ["T"]), (1, "A", ["T"])], "snps") == [["0:A>C"], ["0:A>T", "1:A>T"]]
    # what one table shows beside each other never shares a set
    assert sets_of([(0, "A", ["C"]), (0, "A", ["T"]), (1, "A", ["C"]), (1, "A", ["T"])], "snps") == [["0:A>C", "1:A>C"], ["0:A>T", "1:A>T"]]
    assert sets_of([(0, "A", ["C"]), (0, "A", ["C"]), (1, "A", ["C"])], "exact") == [["0:A>C"], ["0:A>C", "1:A>C"]]
    # a snp and a reference together take no indel in
    assert sets_of([(0, "A", ["C"]), (1, "A", []), (2, "A", ["AT"])], "both_ref") in ([["0:A>C", "1:A>."], ["2:A>AT"]], [["0:A>C"], ["1:A>.", "2:A>AT"]])
    with pytest.raises(ValueError):
        sets_of([one], "none")


def test_pairing_keeps_every_record():
    rng = random.Random(7)
    for _ in range(300):
        records = sorted(((rng.randrange(4), "A", rng.choice([[], ["C"], ["T"], ["C", "T"], ["AT"], ["AT", "C"], ["c"]])) for _ in range(rng.randint(1, 9))), key=lambda r: r[0])
        for pairing in (["exact"], ["some"], ["snps"], ["both_ref"], ["any"], ["indels", "snp_ref"]):
            for s in sets_of(records, *pairing):
                assert len({x.split(":")[0] for x in s}) == len(s)
                if pairing == ["exact"]:
                    assert len({tuple(sorted(x.split(":")[1][2:].upper().split(","))) for x in s}) == 1


def test_synchronized_tables(spark):
    from strandloom.operators.synchronized import sweep, synchronize, targets_by_alleles

    schema = "chr string, pos bigint, ref string, alts array<string>"
    tables = [spark.createDataFrame(rows, schema) for rows in (
        [("c", 1, "A", ["C"]), ("c", 2, "A", ["C"]), (None, 3, "A", ["C"])],
        [("c", 1, "A", ["T"]), ("c", 1, "A", ["C"]), ("d", 2, "A", ["G"])],
        [("c", 2, "A", ["C", "T"]), (None, 3, "A", ["C"])],
    )]
    text = lambda r: None if r is None else f"{r.ref}>{','.join(r.alts)}"
    got = lambda **k: sorted(str((r.chr, r.pos, *map(text, r.records))) for r in synchronize(tables, **k).collect())
    alone = [(None, 3, "A>C", None, None), (None, 3, None, None, "A>C"), ("d", 2, None, "A>G", None)]
    assert got() == sorted(map(str, [("c", 1, "A>C", "A>C", None), ("c", 1, None, "A>T", None), ("c", 2, "A>C", None, None), ("c", 2, None, None, "A>C,T"), *alone]))
    assert got(pairing=("some",)) == sorted(map(str, [("c", 1, "A>C", "A>C", None), ("c", 1, None, "A>T", None), ("c", 2, "A>C", None, "A>C,T"), *alone]))
    assert synchronize([t.limit(0) for t in tables]).count() == 0
    assert [(r.chr, r.pos) for r in sweep(tables[1], backward=True).collect()] == [("d", 2), ("c", 1), ("c", 1)]
    records = spark.createDataFrame([("c", 1, "A", ["AT"]), ("c", 1, "A", ["G"]), ("c", 2, "A", ["AT"]), ("c", 2, "A", ["G"])], schema)
    wanted = spark.createDataFrame([("c", 1, ["A", "AC"]), ("c", 2, ["A", "C"]), ("c", 2, ["A", "T"])], "chr string, pos bigint, alleles array<string>")
    assert sorted((r.pos, r.alts[0]) for r in targets_by_alleles(records, wanted).collect()) == [(1, "AT"), (2, "G")]


def test_record_updates(spark):
    df = spark.sql("select map('DP', '5', 'DB', '') as info, map('a', map('GT', '0/1'), 'b', map('GT', '.', 'DP', '3')) as samples, 'rs1' as id")
    row = df.select(
        V.set_info(df.info, "DP", F.lit(7)), V.set_info(df.info, "DB", None), V.set_format(df.samples, "DP", F.create_map(F.lit("a"), F.lit("9"))), V.set_format(df.samples, "GT", None),
        V.add_id(df.id, F.lit("rs2")), V.add_id(df.id, F.lit("rs1")), V.add_id(F.lit(None), F.lit("x")), V.set_id(df.id, F.lit(".")),
    ).first()
    assert tuple(row) == ({"DB": "", "DP": "7"}, {"DP": "5"}, {"a": {"GT": "0/1", "DP": "9"}, "b": {"GT": ".", "DP": "."}}, {"a": {}, "b": {"DP": "3"}}, "rs1;rs2", "rs1", "x", None)
    table = V.set_alleles(spark.createDataFrame([("A", ["C"])], "ref string, alts array<string>"), F.lit("AT"), F.array(F.lit("A")))
    assert tuple(table.first()) == ("AT", ["A"])


def test_tied_bases_are_ranked_alike(spark):
    """Bases of one quality and strand are one another's equals; the other strand comes behind."""
    rows = [("G", 33, True)] * 3 + [("G", 32, False)] * 2 + [("C", 33, True)] + [("C", 23, True)] * 2 + [("A", 33, True)] * 2
    got = likelihoods(spark, *zip(*rows))
    n = len(rows)
    tail = lambda q, k: sum(math.comb(n, i) * (e := 10 ** (-q / 10)) ** i * (1 - e) ** (n - i) for i in range(k, n + 1))
    weight = lambda j: 0.83**j * 0.97 + 0.03
    step = lambda q, k: -10 * math.log10(tail(q, k + 1) / tail(q, k))
    g = sum(weight(j) * step(33, j) for j in range(3)) + sum(weight(j) * step(32, 3 + j) for j in range(2))
    c = weight(0) * step(33, 0) + weight(1) * step(23, 1) + weight(2) * step(23, 2)
    assert math.isclose(got["AA"], g + c, rel_tol=1e-9)
