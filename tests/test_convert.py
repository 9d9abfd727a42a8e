import math
import random
from collections import Counter

import pytest

from strandloom.functions import alignment as A
from strandloom.operators import convert as C

ALN = "ord bigint, qname string, flag int, chr string, pos bigint, seq string, qual string, xm string, xm_type string"


def test_strand_table(spark):
    cases = [(1 | 2 | 64 | 16, 2), (1 | 2 | 64 | 32, 1), (1 | 2 | 64, 0), (1 | 2 | 128 | 16, 1), (1 | 2 | 128 | 32, 2), (1 | 2 | 128, 0), (1 | 2, 0), (16, 2), (0, 1), (1, None), (2, None)]
    df = spark.createDataFrame(cases, "flag int, want int")
    for r in df.select("*", A.strand_code(df.flag).alias("got")).collect():
        assert r.got == r.want, r.flag


def test_methylation_table(spark):
    df = spark.createDataFrame([(b, w) for b in "CTAGN" for w in (0, 1, 2)], "b string, w int")
    got = {(r.b, r.w): (r.bs, r.taps) for r in df.select("b", "w", A.methylation(df.b, df.w).alias("bs"), A.methylation(df.b, df.w, "TAPS").alias("taps")).collect()}
    assert got[("C", 1)] == ("1", "0") and got[("T", 0)] == ("0", "1") and got[("G", 2)] == ("1", "0") and got[("A", 2)] == ("0", "1")
    assert got[("C", 2)] == (None, None) and got[("G", 1)] == (None, None) and got[("N", 0)] == (None, None)
    with pytest.raises(ValueError):
        A.methylation(df.b, df.w, "XX")


def test_bisulfite_check(spark):
    df = spark.createDataFrame([(None, None), ("zzh.x", "Z"), ("zX", "Z"), ("3", "i")], "xm string, t string")
    assert [r[0] for r in df.select(A.passes_bisulfite_qc(df.xm, df.t)).collect()] == [True, True, False, False]


def simulate(reads, sites, mode="BS", directional=True, evict=None):
    """The procedure, read by read."""
    good = {"C": "1", "T": "0"} if mode == "BS" else {"C": "0", "T": "1"}
    bad = {"G": "1", "A": "0"} if mode == "BS" else {"G": "0", "A": "1"}
    accepted, out, waiting, last_chr = 0, [], {}, None

    def emit(one, two=None):
        if two and max(one["s0"], two["s0"]) <= min(one["e0"], two["e0"]):
            calls = {}
            for r in (one, two):
                for p, m, q in r["calls"]:
                    if p not in calls or q > calls[p][1]:
                        calls[p] = (m, q)
            out.append((one["chr"], min(calls), max(calls), "".join(calls[p][0] for p in sorted(calls)), one["wc"]))
        else:
            for r in filter(None, (one, two)):
                out.append((r["chr"], r["s0"], r["e0"], "".join(m for _, m, _ in r["calls"]), r["wc"]))

    for r in reads:
        f = r["flag"]
        if f & 0xF04 or not r["seq"] or (r["xm"] and set(r["xm"]) & set("XHU")):
            continue
        wc = 0
        if directional:
            if (f & 3) == 3:
                if f & 64:
                    wc = 2 if f & 16 else 1 if f & 32 else 0
                elif f & 128:
                    wc = 1 if f & 16 else 2 if f & 32 else 0
            elif (f & 3) == 0:
                wc = 2 if f & 16 else 1
            else:
                continue
        if r["chr"] != last_chr:
            for w in waiting.values():
                emit(w)
            waiting, last_chr = {}, r["chr"]
        number, accepted = accepted, accepted + 1
        shift = 0 if wc == 2 else 1
        calls, ok = [], True
        for p in sites[r["chr"]]:
            i = p - r["pos"] - shift
            if 0 <= i < len(r["seq"]):
                m = (bad if wc == 2 else good).get(r["seq"][i])
                ok = ok and m is not None
                q = -1 if r["qual"] == "*" else ord(r["qual"][i]) - 33
                calls.append((p, m, q - 256 if q > 127 else q))
        if calls and ok:
            read = {"chr": r["chr"], "wc": wc, "calls": calls, "s0": calls[0][0], "e0": calls[-1][0], "n": number}
            other = waiting.pop(r["qname"], None)
            if other and evict and math.ceil((other["n"] + evict[1] + 1) / evict[0]) * evict[0] <= number + 1:
                emit(other)
                other = None
            if other:
                emit(other, read)
            else:
                waiting[r["qname"]] = read
    for w in waiting.values():
        emit(w)
    return Counter((c, b, e, h, "*+-"[w]) for c, b, e, h, w in out)


def random_reads(rng, n):
    reads = []
    for i in range(n):
        flag = rng.choice([99, 147, 83, 163, 0, 16, 67, 131, 1, 2, 1024, 99, 147])
        length = rng.randint(1, 40)
        minus = flag in (16, 83, 163)
        seq = "".join(rng.choices("GA" if minus else "CT", k=length))
        if rng.random() < 0.1:
            seq = seq[:-1] + rng.choice("ACGTN")
        qual = "*" if rng.random() < 0.1 else "".join(chr(33 + rng.randint(0, 5)) for _ in range(length))
        reads.append({"ord": i, "qname": f"q{rng.randint(0, n // 3)}", "flag": flag, "chr": "c1" if i < n // 2 else "c2", "pos": rng.randint(80, 160), "seq": seq, "qual": qual, "xm": rng.choice([None, None, "zh", "zX"])})
    return reads


@pytest.mark.parametrize("seed,mode,directional,evict", [(1, "BS", True, None), (2, "TAPS", True, None), (3, "BS", False, None), (4, "BS", True, (20, 5))])
def test_convert_equals_the_procedure(spark, seed, mode, directional, evict):
    rng = random.Random(seed)
    reads = random_reads(rng, 240)
    sites = {c: sorted(rng.sample(range(80, 200), 14)) for c in ("c1", "c2")}
    table = spark.createDataFrame([(r["ord"], r["qname"], r["flag"], r["chr"], r["pos"], r["seq"], r["qual"], r["xm"], "Z" if r["xm"] else None) for r in reads], ALN)
    places = spark.createDataFrame([(c, p) for c, ps in sites.items() for p in ps], "chr string, pos bigint")
    every, age = evict or (50_000, 5_000)
    got = C.convert(table, places, directional=directional, mode=mode, evict=bool(evict), every=every, age=age).collect()
    assert Counter({(r.chr, r.beg, r.end, r.hap, r.strand): r.cnt for r in got}) == simulate(reads, sites, mode, directional, evict)


def test_mates_of_long_names_meet_as_walked(spark):
    rng = random.Random(5)
    reads = [(2 * i, rng.choice("ab"), f"q{rng.randint(0, 60)}", i) for i in range(300)]
    want, waiting = [], {}
    for _, c, q, i in reads:
        if (c, q) not in waiting:
            waiting[c, q] = i
            continue
        first = waiting.pop((c, q))
        gone = any(n - 1 - first > 9 for n in range(20, i + 2, 20) if n > first)  # after each 20 reads those older than 9 go
        want.append((c, q, first, i, gone))
        if gone:
            waiting[c, q] = i
    numbers = spark.createDataFrame(reads, "ord bigint, chr string, qname string, idx bigint")
    got = [tuple(r) for r in C.mate_meetings(numbers, 20, 10).collect()]
    assert sorted(got) == sorted(want) and len({x[-1] for x in want}) == 2


def test_query_of_all_names_holds_the_pairs(spark):
    from strandloom.plans import catalogue

    data = "/root/testdata/sf0.001"
    two, whole = ({tuple(r) for r in catalogue.queries()[n](spark, data).collect()} for n in ("mate_evict", "mate_evict_all"))
    assert two < whole and len({r[1] for r in whole - two}) > 0


def test_regions_choose_reads_whole(spark):
    table = spark.createDataFrame([(0, "a", 0, "c", 99, "CT" * 20, "*", None, None), (1, "b", 0, "c", 500, "CT" * 20, "*", None, None)], ALN)
    sites = spark.createDataFrame([("c", 100), ("c", 138), ("c", 510)], "chr string, pos bigint")
    regions = spark.createDataFrame([("c", 100, 101), ("c", 100, 105)], "chr string, beg bigint, end bigint")
    assert [(r.beg, r.end, r.cnt) for r in C.convert(table, sites, regions).collect()] == [(100, 138, 1)]


def test_global_index(spark):
    df = spark.createDataFrame([(i * 70_001,) for i in range(50)], "ord bigint")
    assert [r.idx for r in C.global_index(df, "ord").orderBy("ord").collect()] == list(range(50))


def test_cigar_flags_and_tags(spark):
    df = spark.createDataFrame([(0, 49, "8M"), (5, 199, "*"), (5, 199, "6M2S"), (0, 10, "3S2M1I2D4N1M")], "flag int, pos bigint, cigar string")
    c = df.cigar
    got = [tuple(r) for r in df.select(A.query_length(c), A.reference_length(c), A.end_position(df.flag, df.pos, c)).collect()]
    assert got == [(8, 8, 57), (0, 0, 200), (8, 6, 200), (7, 9, 19)]
    tags = spark.sql("select map('NM', 'i:3', 'XX', 'Z:a:b', 'BB', 'B:c,1,2', 'FF', 'f:1.5') as aux")
    a = tags.aux
    row = tags.select(A.aux_int(a, "NM"), A.aux_get(a, "XX"), A.aux_array(a, "BB"), A.aux_float(a, "FF"), A.aux_get(A.aux_set(a, "NM", "i", A.F.lit(9)), "NM"), A.aux_drop(a, "NM")["NM"], A.aux_int(a, "XX")).first()
    assert tuple(row) == (3, "a:b", [1.0, 2.0], 1.5, "9", None, None)


def test_reads_meet_merged_regions_once(spark):
    """However many regions cover a place: against brute force, and one region a read is met."""
    from strandloom.operators.regions import merged_with_previous

    rng = random.Random(11)
    regions = [(rng.choice("cde"), b, b + rng.randint(-2, 1500)) for b in (rng.randrange(1, 40_000) for _ in range(60))] + [("c", 100, 9000 + i) for i in range(50)]
    reads = [(i, rng.choice("cdf"), rng.randrange(0, 41_000), "A" * rng.choice([0, 1, 50, 3000])) for i in range(400)]
    table = spark.createDataFrame(regions, "chr string, beg bigint, end bigint")
    alignments = spark.createDataFrame(reads, "ord bigint, chr string, pos bigint, seq string")
    want = sorted(o for o, c, p, s in reads if any(c == rc and b <= e and p + 1 <= e and b <= p + max(len(s), 1) for rc, b, e in regions))
    found = C.select_reads(alignments, table)
    assert sorted(r.ord for r in found.collect()) == want and found.columns == alignments.columns
    merged = {c: sorted((r.beg, r.end, r.previous) for r in merged_with_previous(table.where("beg <= end")).where(f"chr = '{c}'").collect()) for c in "cde"}
    for rows in merged.values():
        assert all(p is None if i == 0 else p == rows[i - 1][1] < b - 1 for i, (b, _, p) in enumerate(rows))
    assert sum(b <= 5000 <= e for b, e, _ in merged["c"]) == 1
    assert "Deduplicate" not in found._jdf.queryExecution().analyzed().toString()
