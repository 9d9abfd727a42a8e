import math
import random

import numpy as np
import pytest

from strandloom.operators import realign as R


def posteriors(reference, query, quality):
    """Of each base the probability of every (place, inserted), by all paths through the model."""
    size, length = len(reference), len(query)
    end = 1 / (2 * length + 2)
    stay, o, e = 1 - end, R.GAP_OPEN, R.GAP_EXTEND
    found, total = [{} for _ in query], 0.0

    def emitted(i, k):
        q = 10 ** (-quality[i] / 10)
        return 1.0 if reference[k] > 3 or query[i] > 3 else 1 - q if reference[k] == query[i] else q * R.ERROR

    def walk(i, k, state, p, path):
        nonlocal total
        if state != "D" and i == length - 1:
            total += p * end
            for b, at in enumerate(path):
                found[b][at] = found[b].get(at, 0.0) + p * end
            return
        if k + 1 < size:
            go = {"M": (1 - 2 * o) * stay, "I": (1 - e) * stay, "D": 1 - e}[state]
            if i + 1 < length:
                walk(i + 1, k + 1, "M", p * go * emitted(i + 1, k + 1), [*path, (k + 1, 0)])
            if state != "I" and i > 0:  # no gap right behind the first base
                walk(i, k + 1, "D", p * (o * stay if state == "M" else e), path)
        if state != "D" and i + 1 < length:
            walk(i + 1, k, "I", p * (o if state == "M" else e) * stay * R.INSERTED, [*path, (k, 1)])

    for k in range(size):
        walk(0, k, "M", (1 - o) / size * emitted(0, k), [(k, 0)])
        walk(0, k, "I", o / size * R.INSERTED, [(k, 1)])
    return [{at: p / total for at, p in f.items()} for f in found]


def test_alignment_equals_all_paths():
    rng = np.random.default_rng(3)
    for _ in range(40):
        size, length = int(rng.integers(1, 6)), int(rng.integers(1, 5))
        reference, query = rng.integers(0, 5, (3, size)).astype(np.int8), rng.integers(0, 5, (3, length)).astype(np.int8)
        quality = rng.integers(2, 40, (3, length))
        place, inserted, sure = R.align(reference, query, quality, 10)
        for i in range(3):
            for b, known in enumerate(posteriors(reference[i], query[i], quality[i])):
                top = max(known.values())
                assert math.isclose(known[place[i, b], inserted[i, b]], top, rel_tol=1e-9)
                want = -R.PHRED * math.log(max(1 - top, 1e-300)) + 0.499
                assert abs(sure[i, b] - min(int(min(want, 101)), 99 if want > 100 else 100)) <= (1e-6 > abs(want - round(want)) or want > 60)


def test_reads_of_mixed_lengths_align_as_each_alone():
    rng = np.random.default_rng(5)
    shapes = sorted(((int(rng.integers(1, 40)), int(rng.integers(12, 50))) for _ in range(60)), key=lambda x: -x[0])
    for band in (12, 49):
        some = [(q, r) for q, r in shapes if R._reach(r, q, band) == band]
        references = [rng.integers(0, 5, r).astype(np.int8) for _, r in some]
        queries = [np.where(rng.random(q) < 0.8, np.resize(x[2:], q), rng.integers(0, 5, q)).astype(np.int8) for (q, _), x in zip(some, references)]
        qualities = [rng.integers(2, 40, q) for q, _ in some]
        for i, found in enumerate(R.align_mixed(references, queries, qualities, band) if some else []):
            alone = R.align(references[i][None], queries[i][None], qualities[i][None], band)
            assert all((f == a[0]).all() for f, a in zip(found, alone))


def test_lengths_share_a_group(monkeypatch):
    reads = {("k", i): R._Read(5, [(n, "M")], "ACGT" * 30, "A" * n, np.full(n, 30), 0, 7) for i, n in enumerate([40, 61, 40, 89, 17])}
    (part,) = R._together(reads)
    assert [len(x.seq) for _, x in part] == [89, 61, 40, 40, 17]
    monkeypatch.setattr(R, "STATE_CELLS", 1)
    assert sorted(k for p in R._together(reads) for k, _ in p) == sorted(reads)


def test_windows():
    assert R.window(100, [(50, "M")], 50) == (97, 153, 7) and R.window(1, [(50, "M")], 50) == (0, 54, 7)
    assert R.window(100, [(5, "S"), (40, "M"), (5, "S")], 50) == (92, 148, 7)
    assert R.window(100, [(10, "M"), (5, "N"), (10, "M")], 20) is None and R.window(100, [(10, "I")], 10) is None
    lo, hi, band = R.window(100, [(10, "M"), (30, "D"), (10, "M")], 20)
    assert (lo, hi, band) == (98, 159, 33)


def test_tags_turn_into_each_other(spark):
    rng = random.Random(1)
    genome = "".join(rng.choices("ACGT", k=600))
    rows = []
    for i in range(40):
        pos, n = rng.randint(0, 520), rng.choice([40, 61])
        seq = list(genome[pos : pos + n])
        for _ in range(rng.randint(0, 4)):
            seq[rng.randrange(len(seq))] = rng.choice("ACGTN")
        cigar = f"{len(seq)}M"
        if i % 4 == 1:
            seq[20:20] = "GG"
            cigar = f"20M2I{len(seq) - 22}M"
        if i % 4 == 2:
            del seq[20:23]
            cigar = f"20M3D{len(seq) - 20}M"
        rows.append((i, 0, pos, cigar, "".join(seq), "".join(chr(33 + rng.randint(3, 40)) for _ in seq), {"NM": "i:1"}))
    rows += [(90, 4, 5, "4M", "ACGT", "IIII", {}), (91, 0, 5, "*", "*", "*", None), (92, 0, 5, "4M", "ACGT", "*", {}), (93, 0, 5, "2M9N2M", "ACGT", "IIII", {}), (94, 0, 5, "4I", "ACGT", "IIII", {}), (95, 0, 700, "4M", "ACGT", "IIII", {})]
    schema = "ord bigint, flag int, pos bigint, cigar string, seq string, qual string, aux map<string,string>"
    from pyspark.sql import functions as F

    reads = spark.createDataFrame(rows, schema).withColumns({"reference": F.lit(genome), "reference_start": F.lit(0).cast("bigint")}).repartition(3)
    show = lambda t: {r.ord: (r.qual, r.aux) for r in t.collect()}
    plain, tagged, applied = show(reads), show(R.base_alignment_quality(reads)), show(R.base_alignment_quality(reads, apply=True))
    changed = [i for i in range(40) if set(tagged[i][1]["BQ"][2:]) != {"@"}]
    assert len(changed) > 5
    for i, (qual, aux) in plain.items():
        if i >= 90:
            assert tagged[i] == applied[i] == (qual, aux)
            continue
        lost = [ord(c) - 64 for c in tagged[i][1]["BQ"][2:]]
        assert tagged[i][0] == qual and applied[i][1]["ZQ"] == tagged[i][1]["BQ"] and min(lost) >= 0
        assert applied[i][0] == "".join(chr(ord(q) - v) for q, v in zip(qual, lost))
    # each form turns into the other, and a second pass changes nothing
    assert show(R.base_alignment_quality(R.base_alignment_quality(reads), apply=True)) == applied
    assert show(R.base_alignment_quality(R.base_alignment_quality(reads, apply=True))) == tagged
    assert show(R.base_alignment_quality(R.base_alignment_quality(reads, apply=True), apply=True)) == applied
    assert show(R.base_alignment_quality(R.base_alignment_quality(reads, extend=True), redo=True)) == tagged
    # the extended quality is no stricter
    extended = show(R.base_alignment_quality(reads, extend=True))
    assert all(a <= b for i in range(40) for a, b in zip(extended[i][1]["BQ"][2:], tagged[i][1]["BQ"][2:]))
    short = reads.where("ord = 0").withColumn("aux", F.create_map(F.lit("ZQ"), F.lit("Z:@")))
    with pytest.raises(Exception, match="ZQ"):
        R.base_alignment_quality(short).collect()


def test_reference_stretches(spark):
    genome = "".join(random.Random(2).choices("ACGT", k=900))
    chunks = spark.createDataFrame([("c", k, genome[k : k + 60]) for k in range(0, 900, 60)], "name string, offset bigint, seq string")
    rows = [(0, 0, "c", 5, "30M", genome[5:35], "I" * 30, {}), (1, 0, "c", 400, "10M40D30M", genome[400:410] + genome[450:480], "I" * 40, {}), (2, 0, "c", 880, "30M", genome[880:] + "A" * 10, "I" * 30, {}), (3, 4, "*", -1, "*", "ACG", "III", {})]
    reads = spark.createDataFrame(rows, "ord bigint, flag int, chr string, pos bigint, cigar string, seq string, qual string, aux map<string,string>")
    from pyspark.sql import functions as F

    cut = R.with_reference(reads, chunks)
    whole = reads.withColumns({"reference": F.lit(genome), "reference_start": F.lit(0).cast("bigint")})
    show = lambda t: {r.ord: (r.qual, r.aux) for r in R.base_alignment_quality(t).collect()}
    assert show(cut) == show(whole) and "BQ" in show(cut)[0][1]
