import gzip
import io
import random

import pytest

from strandloom.plans import cli
from strandloom.sources import bam, bgzf, sam, sequences, text
from strandloom.sources import variants as vcf
from strandloom.sources.detect import detect_format
from strandloom.sources.tickets import read_ticket
from strandloom.streaming.counts import counts_until_done

SAM = "@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:1000\n@PG\tID:a\nr1\t99\tchr1\t100\t20\t40M\t=\t120\t60\t" + "CT" * 20 + "\t" + "I" * 40 + "\tXM:Z:zzh.\tNM:i:3\nr1\t147\tchr1\t110\t20\t40M\t=\t100\t-60\t" + "TC" * 20 + "\t*\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n"


def test_haplotype_files(spark, tmp_path):
    path = tmp_path / "a.mhap.gz"
    lines = b"chr1\t100\t175\t011\t2\t+\nchr1\t138\t138\t1\t4\t*\n"
    path.write_bytes(bgzf.compress(lines))  # block gzip is gzip in several members
    table = text.read_haplotypes(spark, str(path))
    assert sorted(map(tuple, table.collect())) == [("chr1", 100, 175, "011", 2, "+"), ("chr1", 138, 138, "1", 4, "*")]
    text.write_haplotypes(table, str(tmp_path / "out.mhap.gz"))
    assert sorted(map(tuple, text.read_haplotypes(spark, str(tmp_path / "out.mhap.gz")).collect())) == sorted(map(tuple, table.collect()))
    with pytest.raises(ValueError):
        text.write_haplotypes(table, str(tmp_path / "out.txt"))
    (tmp_path / "short.mhap").write_text("chr1\t100\t175\t011\t2\n")
    with pytest.raises(Exception):
        text.read_haplotypes(spark, str(tmp_path / "short.mhap")).collect()


def test_block_gzip(spark, tmp_path):
    data = bytes(range(256)) * 1000
    packed = bgzf.compress(data)
    assert b"".join(d for _, d in bgzf.blocks(io.BytesIO(packed))) == data == gzip.decompress(packed)
    assert bgzf.read_range(io.BytesIO(packed), 65_000, 1000) == data[65_000:66_000]
    rows = spark.createDataFrame([("b", i) for i in range(50)] + [("a", 5)], "chr string, pos bigint")
    bgzf.write_table(rows, str(tmp_path / "t"), ["chr", "pos"])
    joined = b"".join(p.read_bytes() for p in sorted((tmp_path / "t").glob("part-*.gz")))
    assert gzip.decompress(joined).decode().splitlines() == ["a\t5"] + [f"b\t{i}" for i in range(50)]


def test_sites_and_regions(spark, tmp_path):
    (tmp_path / "s.txt").write_text("#h\nchr1\t100\t101\n\nchr1\t138\t139\n")
    assert sorted(map(tuple, text.read_sites(spark, str(tmp_path / "s.txt")).collect())) == [("chr1", 100), ("chr1", 138)]
    (tmp_path / "r.bed").write_text("#x\nchr2\t5\t9\n\nchr1\t1\t2\tname\nchr3\n")
    assert [tuple(r)[1:] for r in text.read_bed(spark, str(tmp_path / "r.bed")).orderBy("ord").collect()] == [("chr2", 5, 9), ("chr1", 1, 2), ("chr3", 0, (1 << 63) - 1)]
    (tmp_path / "r.tab").write_text("chr2\t5\t9\nchr1\t7\n")
    assert [tuple(r)[1:] for r in text.read_regions(spark, str(tmp_path / "r.tab")).orderBy("ord").collect()] == [("chr2", 4, 9), ("chr1", 6, 7)]
    (tmp_path / "r.reg").write_text("chr1:5-9\nchr2\nchr3:8\n")
    assert [tuple(r)[1:] for r in text.read_regions(spark, str(tmp_path / "r.reg")).orderBy("ord").collect()] == [("chr1", 4, 9), ("chr2", 0, (1 << 63) - 1), ("chr3", 7, 8)]
    assert [r.name for r in text.read_list(spark, "a,b").collect()] == ["a", "b"]


def test_sam_round_trip_and_header(spark, tmp_path):
    (tmp_path / "a.sam").write_text(SAM)
    records = sam.read_sam(spark, str(tmp_path / "a.sam"))
    assert [(r.qname, r.flag, r.pos, r.xm, r.xm_type) for r in records.orderBy("ord").collect()] == [("r1", 99, 99, "zzh.", "Z"), ("r1", 147, 109, None, None), ("r2", 4, -1, None, None)]
    assert [r.value for r in sam.sam_lines(records).collect()] == SAM.splitlines()[3:]
    head = sam.read_header(spark, str(tmp_path / "a.sam"))
    head = sam.update_header(sam.add_header_line(head, "PG", {"ID": "b"}), "SQ", "SN", "chr1", {"LN": "2000"})
    lines = [r.value for r in sam.header_lines(head).collect()]
    assert lines[0] == "@HD\tVN:1.6" and lines[1] == "@SQ\tSN:chr1\tLN:2000" and set(lines[3].split("\t")) == {"@PG", "ID:b", "PP:a"}
    assert sam.remove_header_lines(head, "PG", "ID", "a").count() == 3


def test_bam_round_trip_and_pushdown(spark, tmp_path):
    (tmp_path / "a.sam").write_text(SAM)
    want = sam.read_sam(spark, str(tmp_path / "a.sam")).orderBy("ord").collect()
    rows = [{**r.asDict(), "aux": r["aux"]} for r in want]
    (tmp_path / "a.bam").write_bytes(bam.encode(rows, [("chr1", 1000)], "@HD\tVN:1.6\n"))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    got = bam.read_bam(spark, str(tmp_path / "a.bam"))
    keep = ["qname", "flag", "chr", "pos", "mapq", "cigar", "mchr", "mpos", "tlen", "seq", "qual", "aux", "xm"]
    assert [tuple(r[c] for c in keep) for r in got.orderBy("ord").collect()] == [tuple(r[c] for c in keep) for r in want]
    assert [r.qname for r in got.where("chr = 'chr1' and pos > 100").collect()] == ["r1"]


def made_reads(rng, n, names=("chr1", "chr2", "chr3")):
    rows, at = [], 0
    for i in range(n):
        if i % (n // 3 + 1) == 0:
            at = 0
        at += rng.randint(0, 900)
        size = rng.choice([0, 5, 80, 150, 150, 4000])
        mapped = rng.random() < 0.97
        cigar = "*" if not mapped or not size else rng.choice([f"{size}M", f"2S{size - 2}M", f"{size - 3}M{rng.randint(1, 40000)}N3M"]) if size > 4 else f"{size}M"
        rows.append({
            "ord": i, "qname": f"r{i}" + "x" * rng.randint(0, 200), "flag": 0 if mapped else 4, "chr": names[min(2, i // (n // 3 + 1))], "pos": at, "mapq": 30, "cigar": cigar, "mchr": "*", "mpos": -1, "tlen": 0,
            "seq": "".join(rng.choices("ACGT", k=size)) or "*", "qual": "I" * size or "*", "aux": {"XM": "Z:" + "z" * rng.randint(0, 30), "NM": f"i:{i % 9}", "ZB": "B:s,1,-2"},
        })
    return rows


BAM_REFS = [("chr1", 1 << 24), ("chr2", 1 << 24), ("chr3", 1 << 24)]
BAM_HEAD = "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{n}\tLN:{k}\n" for n, k in BAM_REFS)
BAM_COLUMNS = ["qname", "flag", "chr", "pos", "mapq", "cigar", "mchr", "mpos", "tlen", "seq", "qual"]


def bam_rows(frame):
    return [(*(r[c] for c in BAM_COLUMNS), tuple(sorted(r.aux.items()))) for r in frame.orderBy("ord").collect()]


def want_rows(rows):
    return [(*(r[c] for c in BAM_COLUMNS), tuple(sorted(r["aux"].items()))) for r in rows]


def test_bam_in_splits(spark, tmp_path):
    rng = random.Random(4)
    rows = made_reads(rng, 1500)
    path = str(tmp_path / "a.bam")
    (tmp_path / "a.bam").write_bytes(bam.encode(rows, BAM_REFS, BAM_HEAD))
    whole = want_rows(rows)
    size = (tmp_path / "a.bam").stat().st_size
    for split in (1 << 26, size // 2, size // 7, 30_000, 5_000):
        table = bam.read_bam(spark, path, split_bytes=split)
        assert table.rdd.getNumPartitions() == -(-size // split) and bam_rows(table) == whole
        assert table.select("ord").distinct().count() == len(rows)


def test_bam_folder_and_default_session(spark, tmp_path):
    from strandloom.operators.convert import select_reads

    rng = random.Random(5)
    both = [made_reads(rng, 50), made_reads(rng, 50)]
    for name, rows in zip("ba", both):
        (tmp_path / f"{name}.bam").write_bytes(bam.encode(rows, BAM_REFS, BAM_HEAD))
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    table = bam.read_bam(spark, str(tmp_path))
    assert bam_rows(table) == want_rows(both[1] + both[0]) and table.select("ord").distinct().count() == 100
    every = spark.createDataFrame([(n, 1, 1 << 30) for n, _ in BAM_REFS], "chr string, beg bigint, end bigint")
    assert select_reads(table, every).count() == 100


def test_bam_index_and_regions(spark, tmp_path):
    rng = random.Random(6)
    rows = made_reads(rng, 1500)
    path = str(tmp_path / "a.bam")
    (tmp_path / "a.bam").write_bytes(bam.encode(rows, BAM_REFS, BAM_HEAD))
    over = lambda r, c, b, e: r["chr"] == c and r["pos"] < e and r["pos"] + max(1, bam._span(r["cigar"])) > b
    regions = [("chr1", 0, 1 << 24), ("chr2", 100_000, 101_000), ("chr2", 16_384, 16_385), ("chr3", 90_000, 200_000), ("chr3", 1 << 23, 1 << 24), ("chr9", 0, 10)]
    for indexed in (False, True):
        if indexed:
            bam.index_bam(spark, path, split_bytes=40_000)
        for region in regions:
            got = bam.read_bam(spark, path, region, split_bytes=60_000)
            assert bam_rows(got) == want_rows([r for r in rows if over(r, *region)]), region
    # a region reads the chunks that may hold it, not the file
    reader = bam.BamReader({"path": path, "chr": "chr2", "beg": "100000", "end": "101000"})
    size = (tmp_path / "a.bam").stat().st_size
    assert 0 < sum((p.hi >> 16) - (p.lo >> 16) for p in reader.partitions()) < size / 4
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    assert bam_rows(bam.read_bam(spark, path).where("chr = 'chr2' AND pos >= 50000 AND pos < 90000")) == want_rows([r for r in rows if r["chr"] == "chr2" and 50_000 <= r["pos"] < 90_000])
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    with pytest.raises(Exception):
        (tmp_path / "u.bam").write_bytes(bam.encode(rows[::-1], BAM_REFS, BAM_HEAD))
        bam.index_bam(spark, str(tmp_path / "u.bam"))


def test_bam_writer(spark, tmp_path):
    rows = made_reads(random.Random(7), 300)
    (tmp_path / "a.bam").write_bytes(bam.encode(rows, BAM_REFS, BAM_HEAD))
    table = bam.read_bam(spark, str(tmp_path / "a.bam"), split_bytes=30_000)
    bam.write_bam(table.repartitionByRange(4, "ord").sortWithinPartitions("ord"), str(tmp_path / "out"), BAM_HEAD)
    parts = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert len(parts) > 1 and all(p.endswith(".bam") for p in parts)
    assert bam_rows(bam.read_bam(spark, str(tmp_path / "out"))) == want_rows(rows)
    text, refs, _ = bam.read_header(str(tmp_path / "out" / parts[0]))
    assert text == BAM_HEAD and refs == BAM_REFS
    bam.write_bam(table.limit(0), str(tmp_path / "none"), BAM_HEAD)
    assert bam.read_bam(spark, str(tmp_path / "none")).count() == 0


def test_vcf(spark, tmp_path):
    (tmp_path / "a.vcf").write_text('##fileformat=VCFv4.2\n##INFO=<ID=DP,Number=1,Type=Integer,Description="x">\n##INFO=<ID=AC,Number=A,Type=Integer,Description="x">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\n1\t10\t.\tA\tC,G\t30\tPASS\tDP=5;AC=1,2;DB\tGT:DP\t0/1:3\t1/2\n')
    head = vcf.read_vcf_header(spark, str(tmp_path / "a.vcf"))
    assert {(r.id, r.number, r.type) for r in head.collect()} == {("DP", "1", "Integer"), ("AC", "A", "Integer")}
    records = vcf.read_vcf(spark, str(tmp_path / "a.vcf"))
    row = records.select(vcf.typed_info(records.info, "DP", "Integer", "1"), vcf.typed_info(records.info, "AC", "Integer", "A"), vcf.typed_info(records.info, "DB", "Flag", "0"), records.samples["B"]["DP"], records.alts).first()
    assert tuple(row) == (5, [1, 2], True, ".", ["C", "G"])
    assert vcf.vcf_lines(records, ["A", "B"]).first().value == "1\t10\t.\tA\tC,G\t30\tPASS\tDP=5;AC=1,2;DB\tGT:DP\t0/1:3\t1/2:."


def test_fasta_and_fastq(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one x\nACGT\nacg\n>two\nTTTT\n")
    chunks = sequences.read_fasta(spark, str(tmp_path / "a.fa"))
    assert {r.name: r.length for r in sequences.lengths(chunks).collect()} == {"one": 7, "two": 4}
    regions = spark.createDataFrame([(0, "one", 2, 6), (1, "two", 1, 99)], "ord bigint, chr string, beg bigint, end bigint")
    assert {r.ord: r.seq for r in sequences.fetch(chunks, regions).collect()} == {0: "GTAC", 1: "TTT"}
    (tmp_path / "a.fq").write_text("@r1 z\nAC\n+\nII\n@r2\nGT\n+\nJJ\n")
    records = sequences.read_fastq(spark, str(tmp_path / "a.fq")).select("name", "seq", "qual")
    assert sorted(map(tuple, records.collect())) == [("r1", "AC", "II"), ("r2", "GT", "JJ")]


def test_fastq_over_splits_and_files(spark, tmp_path):
    rng = random.Random(2)
    want = []
    for f in range(3):
        with open(tmp_path / f"{f}.fq", "w") as out:
            for i in range(400):
                n = rng.randint(0, 60)
                seq, qual = "".join(rng.choices("ACGTN", k=n)), "".join(rng.choices("@+I#>", k=n))
                want.append((f"r{f}.{i}", seq, qual))
                out.write(f"@r{f}.{i} more\n{seq}\n+\n{qual}\n")
            out.write("\n" * f)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700", "5000", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = sequences.read_fastq(spark, str(tmp_path))
            assert [tuple(r) for r in got.orderBy("file", "ord").select("name", "seq", "qual").collect()] == want
        (tmp_path / "cut").mkdir()
        (tmp_path / "cut" / "a.fq").write_text("@a\nAC\n+\nII\n@b\nAC\n")
        with pytest.raises(Exception, match="FASTQ"):
            sequences.read_fastq(spark, str(tmp_path / "cut")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_fasta_over_splits_and_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sequences, "STRETCH", 64)
    rng = random.Random(3)
    want = {}
    for f in range(3):
        with open(tmp_path / f"{f}.fa", "w") as out:
            for i in range(5):
                name, seq = f"s{f}.{i}", "".join(rng.choices("ACGTacgt", k=rng.randint(0, 9000)))
                want[name] = seq.upper()
                out.write(f">{name} x\n" + "".join(seq[k : k + 60] + "\n" for k in range(0, len(seq), 60)) + "\n" * (i % 2))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1500", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {}
            for r in sequences.read_fasta(spark, str(tmp_path)).orderBy("name", "offset").collect():
                assert len(got.get(r.name, "")) == r.offset
                got[r.name] = got.get(r.name, "") + r.seq
            assert got == {k: v for k, v in want.items() if v}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_detect_format():
    assert detect_format(bgzf.compress(b"BAM\1x")) == ("bam", "bgzf") and detect_format(gzip.compress(b"chr1\t1\t2\t01\t3\t+\n")) == ("mhap", "gzip")
    assert detect_format(b"##fileformat=VCFv4.2\n")[0] == "vcf" and detect_format(b">a\nAC\n")[0] == "fasta" and detect_format(b"@r\nAC\n+\nII\n")[0] == "fastq"
    assert detect_format(SAM.encode())[0] == "sam" and detect_format(b"chr1\t5\t9\n")[0] == "bed" and detect_format(b"")[0] == "empty"


def test_commands(spark, tmp_path):
    (tmp_path / "a.sam").write_text(SAM)
    (tmp_path / "s.txt").write_text("chr1\t101\t102\nchr1\t120\t121\n")
    (tmp_path / "r.bed").write_text("chr1\t99\t130\nchr2\t1\t5\n")
    at = lambda n: str(tmp_path / n)
    cli.run(spark, ["convert", "-i", at("a.sam"), "-c", at("s.txt"), "-o", at("o.mhap.gz")])
    cli.run(spark, ["merge", "-i", at("o.mhap.gz"), at("o.mhap.gz"), "-o", at("m.mhap.gz")])
    cli.run(spark, ["beta", "-i", at("m.mhap.gz"), "-c", at("s.txt"), "-o", at("b")])
    cli.run(spark, ["summary", "-i", at("m.mhap.gz"), "-b", at("r.bed"), "-o", at("y")])
    merged = text.read_haplotypes(spark, at("m.mhap.gz")).collect()
    assert sum(r.cnt for r in merged) == 2 * sum(r.cnt for r in text.read_haplotypes(spark, at("o.mhap.gz")).collect()) > 0
    assert spark.read.text(at("b")).count() == 2
    summary = spark.read.csv(at("y"), sep="\t", header=True)
    assert summary.columns[:4] == ["Chr", "Start", "End", "Strand"] and summary.count() == 2
    for bad in (["summary", "-i", "x"], ["summary", "-i", "x", "-g"], ["merge", "-i", "x"], ["convert", "-i", "a", "-c", "b", "-r", "c", "-b", "d"]):
        with pytest.raises(ValueError):
            cli.run(spark, bad)


def test_stream_of_a_folder(spark, tmp_path):
    import datetime as dt

    rows = [(i, dt.datetime(2024, 1, 1, i % 3), "click" if i % 2 else "view", float(i)) for i in range(30)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, event_type string, value double").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    out = counts_until_done(spark, str(tmp_path / "events.parquet")).collect()
    assert sum(r.cnt for r in out) == 30 and sum(r.meth for r in out) == 20 and len(out) == 6


def test_empty_summary_has_no_header(spark, tmp_path):
    schema = "ord bigint, chr string, beg bigint, end bigint, strand string, nReads bigint, mBase bigint, tBase bigint, cBase bigint, K4plus bigint, nDR bigint, nMR bigint"
    rows = spark.createDataFrame([(0, "c", 1, 2, "*", 1, 1, 1, 1, 1, 1, 1)], schema)
    for name, table, lines in (("none", rows.limit(0), 0), ("one", rows, 2)):
        text.write_summary(table, str(tmp_path / name))
        assert spark.read.text(str(tmp_path / name)).count() == lines


def test_range_scans_reach_the_files(spark, tmp_path, capsys):
    table = spark.range(0, 5000).selectExpr("concat('c', id % 2) AS chr", "id * 10 AS beg", "id * 10 + 25 AS end", "'1' AS hap")
    text.store_clustered(table, str(tmp_path / "t"))
    found = text.scan_range(spark, str(tmp_path / "t"), "c1", 100, 200)
    assert sorted(r.beg for r in found.collect()) == [x * 10 for x in range(8, 21) if x % 2]
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert all(f in plan for f in ("EqualTo(chr,c1)", "LessThanOrEqual(beg,200)", "GreaterThanOrEqual(end,100)"))


def test_stream_over_many_batches_and_none(spark, tmp_path):
    import datetime as dt

    schema = "event_id bigint, ts timestamp, event_type string, value double"
    rows = [(i, dt.datetime(2024, 1, 1 + i % 5, i % 7), "click" if i % 2 else "view", float(i % 20)) for i in range(200)]
    spark.createDataFrame(rows, schema).repartition(6).write.parquet(str(tmp_path / "a" / "events.parquet"))
    want = {}
    for _, ts, kind, value in rows:
        n, m = want.get((ts, kind), (0, 0))
        want[ts, kind] = (n + 1, m + (value >= 10))
    assert {(r.window_start, r.chr): (r.cnt, r.meth) for r in counts_until_done(spark, str(tmp_path / "a" / "events.parquet")).collect()} == want
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "b" / "events.parquet"))
    assert counts_until_done(spark, str(tmp_path / "b" / "events.parquet")).count() == 0


def test_merged_headers(spark):
    one = sam.parse_header(spark.createDataFrame([("@HD\tVN:1.6", 0), ("@SQ\tSN:a\tLN:1", 1)], "value string, line bigint"))
    two = sam.parse_header(spark.createDataFrame([("@HD\tVN:1.5", 0), ("@SQ\tSN:b\tLN:2", 1), ("@SQ\tSN:a\tLN:9", 2)], "value string, line bigint"))
    assert [r.value for r in sam.header_lines(sam.merge_headers(one, two)).collect()] == ["@HD\tVN:1.6", "@SQ\tSN:a\tLN:1", "@SQ\tSN:b\tLN:2"]


def test_bcf(spark, tmp_path):
    from strandloom.sources import bcf

    head = '##fileformat=VCFv4.2\n##FILTER=<ID=q10,Description="x">\n##contig=<ID=1>\n##contig=<ID=2>\n##INFO=<ID=DP,Number=1,Type=Integer,Description="x">\n##INFO=<ID=AF,Number=A,Type=Float,Description="x">\n##FORMAT=<ID=GT,Number=1,Type=String,Description="x">\n##FORMAT=<ID=PL,Number=G,Type=Integer,Description="x">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\n'
    rows = [
        {"chr": "2", "pos": 10, "id": None, "ref": "A", "alts": ["C", "GGGGGGGGGGGGGGGGGGGG"], "qual": 30.0, "filters": ["PASS"], "info": {"DP": [5], "AF": [0.5, None]}, "calls": {"GT": [[2, 4], [0, 5]], "PL": [[1, None, 3], [4, 5, 6]]}},
        {"chr": "1", "pos": 99, "id": "rs1", "ref": "T", "alts": [], "qual": None, "filters": [], "info": {}, "calls": {}},
    ]
    (tmp_path / "a.bcf").write_bytes(bcf.encode(head, rows))
    got = [r.asDict(recursive=True) for r in bcf.read_bcf(spark, str(tmp_path / "a.bcf")).collect()]
    assert got[0] == {"chr": "2", "pos": 10, "id": None, "ref": "A", "alts": ["C", "G" * 20], "qual": 30.0, "filters": ["PASS"], "info": {"DP": "5", "AF": "0.5,."}, "samples": {"A": {"GT": "0/1", "PL": "1,.,3"}, "B": {"GT": ".|1", "PL": "4,5,6"}}}
    assert got[1]["id"] == "rs1" and got[1]["qual"] is None and got[1]["alts"] == [] and got[1]["filters"] == []


def test_stream_of_mates(spark, tmp_path):
    import datetime as dt

    from strandloom.streaming.mates import pair_stream

    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    schema = "chr string, qname string, ord bigint, ts timestamp"
    batches = [[("c", "a", 0, at(0)), ("c", "b", 1, at(1))], [("c", "a", 2, at(2)), ("d", "b", 3, at(3))], [("c", "z", 4, at(9000))], [("c", "z", 5, at(9001))]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = pair_stream(stream, "ts").writeStream.format("memory").queryName("mates").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {tuple(r) for r in spark.table("mates").collect()}
    assert ("c", "a", 0, 2) in got and ("c", "z", 4, 5) in got and ("c", "b", 1, None) in got and ("d", "b", 3, None) in got and len(got) == 4


def test_header_lines_and_names(spark):
    head = sam.parse_header(spark.createDataFrame([("@HD\tVN:1.6", 0), ("@SQ\tSN:a\tLN:1", 1), ("@SQ\tSN:b\tLN:2", 2), ("@PG\tID:x", 3), ("@PG\tID:y\tPP:x", 4)], "value string, line bigint"))
    assert sam.count_header_lines(head, "SQ") == 2 and sam.count_header_lines(head, "RG") == 0
    assert [r.tags["SN"] for r in sam.find_header_lines(head, "SQ").collect()] == ["a", "b"] and sam.find_header_lines(head, "SQ", "SN", "b").count() == 1
    assert sam.header_tag(head, "SQ", "SN", "b", "LN") == "2" and sam.header_tag(head, "SQ", "SN", "z", "LN") is None
    cut = sam.remove_header_tag(head, "SQ", "SN", "b", "LN")
    assert [r.value for r in sam.header_lines(cut).collect()][2] == "@SQ\tSN:b"
    renamed = [r.value for r in sam.header_lines(sam.rename_header_line(head, "PG", "ID", "x", "z")).collect()]
    assert renamed[3:] == ["@PG\tID:z", "@PG\tID:y\tPP:z"]
    with pytest.raises(ValueError):
        sam.rename_header_line(head, "SQ", "SN", "a", "b")
    from pyspark.sql import functions as F

    reads = spark.createDataFrame([("r1", 1)], "qname string, ord bigint")
    assert sam.set_query_name(reads, F.concat("qname", F.lit("/1"))).first().qname == "r1/1"
    for bad in ("", "a b", "x" * 255):
        with pytest.raises(Exception, match="query name"):
            sam.set_query_name(reads, F.lit(bad)).collect()


def test_merged_variant_headers(spark):
    lines = lambda *v: vcf.header_table(spark.createDataFrame([(x, i) for i, x in enumerate(v)], "value string, line bigint"))
    one = lines("##fileformat=VCFv4.2", "##source=a", "##INFO=<ID=DP,Number=1,Type=Integer>", "##contig=<ID=1>", "#CHROM\tPOS")
    two = lines("##fileformat=VCFv4.3", "##source=b", "##cmd=x", "##cmd=y", "##INFO=<ID=DP,Number=1,Type=Float>", "##INFO=<ID=AF,Number=A,Type=Float>", "##FORMAT=<ID=DP,Number=1,Type=Integer>", "##contig=<ID=1>", "##contig=<ID=2>")
    got = vcf.merge_headers(one, two).orderBy("line").collect()
    assert [r.value for r in got] == ["##fileformat=VCFv4.2", "##source=a", "##INFO=<ID=DP,Number=1,Type=Integer>", "##contig=<ID=1>", "##cmd=x", "##cmd=y", "##INFO=<ID=AF,Number=A,Type=Float>", "##FORMAT=<ID=DP,Number=1,Type=Integer>", "##contig=<ID=2>"]
    assert [r.id for r in got if r.conflict] == ["DP"]


def test_chromosomes_in_the_header_s_order(spark, tmp_path):
    text_ = "@HD\tVN:1.6\n@SQ\tSN:chrB\tLN:1000\n@SQ\tSN:chrA\tLN:1000\n" + "".join(f"r{c}{i}\t0\tchr{c}\t{100 + i}\t20\t40M\t*\t0\t0\t{'CT' * 20}\t*\n" for c in "AB" for i in (4, 0))
    (tmp_path / "a.sam").write_text(text_)
    (tmp_path / "s.txt").write_text("".join(f"chr{c}\t{p}\t{p + 1}\n" for c in "AB" for p in (110, 120)))
    cli.run(spark, ["convert", "-i", str(tmp_path / "a.sam"), "-c", str(tmp_path / "s.txt"), "-o", str(tmp_path / "o.mhap.gz")])
    lines = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "o.mhap.gz").glob("part-*"))).decode().splitlines()
    assert [x.split("\t")[0] for x in lines] == ["chrB"] * (len(lines) // 2) + ["chrA"] * (len(lines) // 2) and lines
    # by content, whatever the name
    (tmp_path / "plain").write_bytes(bam.encode([], [("chr1", 10)], "@HD\tVN:1.6\n"))
    assert cli._is_bam(str(tmp_path / "plain")) and not cli._is_bam(str(tmp_path / "a.sam")) and cli._is_bam(str(tmp_path) + "/none.bam")


def test_block_offsets():
    data = bytes(random.Random(1).randrange(4) for _ in range(300_000))
    packed = io.BytesIO(bgzf.compress(data))
    index = bgzf.block_index(packed)
    assert [c for _, c in index[:-1]] == list(range(0, 300_000, bgzf.BLOCK))
    for offset, size in ((0, 10), (65_279, 5), (65_280, 5), (200_000, 90_000), (299_990, 100), (400_000, 5)):
        assert bgzf.read_indexed(packed, index, offset, size) == data[offset : offset + size]
    assert bgzf.read_at(packed, index[2][0] << 16 | 17, 70_000) == data[2 * bgzf.BLOCK + 17 :][:70_000]
    assert bgzf.read_indexed(io.BytesIO(b""), [], 0, 5) == b""


def test_tickets(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"htsget": {"format": "BAM", "urls": [{"url": "data:application/x;base64,QUJD"}, {"url": "https://a/b?c=\\u0041", "headers": {"Range": "bytes=0-9", "X": "\\"q\\""}}, {"url": "data:,a%20b+c"}]}}')
    got = read_ticket(spark, str(tmp_path / "t.json")).orderBy("part").collect()
    assert [(r.format, r.url, r.data and bytes(r.data)) for r in got] == [("BAM", "data:application/x;base64,QUJD", b"ABC"), ("BAM", "https://a/b?c=A", None), ("BAM", "data:,a%20b+c", b"a b+c")]
    assert got[1].headers == {"Range": "bytes=0-9", "X": '"q"'}
    (tmp_path / "no.json").write_text("[1, 2")
    with pytest.raises(Exception, match="ticket"):
        read_ticket(spark, str(tmp_path / "no.json")).collect()


def test_custom_parsers_and_clients(spark, tmp_path):
    from pyspark.sql import functions as F

    from strandloom.operators.pileup import aligned_positions

    (tmp_path / "r.txt").write_text("x;c1;5;9;a\n# none\nbad\nx;c2;1;2;b\n")
    cut = lambda v, i: F.get(F.split(v, ";"), F.lit(i))
    parser = lambda v: F.when(F.size(F.split(v, ";")) == 5, F.struct(cut(v, 1).alias("chr"), cut(v, 2).cast("bigint").alias("beg"), cut(v, 3).cast("bigint").alias("end"), cut(v, 4).alias("payload")))
    assert [tuple(r)[1:] for r in text.read_regions(spark, str(tmp_path / "r.txt"), parser=parser).orderBy("ord").collect()] == [("c1", 5, 9, "a"), ("c2", 1, 2, "b")]
    reads = spark.createDataFrame([(0, "c", 0, 4, "3M", "ACG")], "ord bigint, chr string, flag int, pos bigint, cigar string, seq string")
    assert [(r.position, r.client) for r in aligned_positions(reads, F.length("seq")).collect()] == [(5, 3), (6, 3), (7, 3)]


def test_bcf_writer_and_reheader(spark, tmp_path):
    from strandloom.sources import bcf

    head = '##fileformat=VCFv4.2\n##FILTER=<ID=q10,Description="x">\n##contig=<ID=1>\n##contig=<ID=2>\n##INFO=<ID=DP,Number=1,Type=Integer,Description="x">\n##INFO=<ID=AF,Number=A,Type=Float,Description="x">\n##INFO=<ID=DB,Number=0,Type=Flag,Description="x">\n##INFO=<ID=S,Number=1,Type=String,Description="x">\n##FORMAT=<ID=GT,Number=1,Type=String,Description="x">\n##FORMAT=<ID=PL,Number=G,Type=Integer,Description="x">\n##FORMAT=<ID=T,Number=1,Type=String,Description="x">\n'
    columns = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\n"
    body = "2\t10\t.\tA\tC,GG\t30\tPASS\tDP=5;AF=0.5,.;DB;S=x,y\tGT:PL:T\t0/1:1,.,3:ab\t.|2:4:c\n" + "".join(f"1\t{i}\trs{i}\tT\tC\t.\tq10\t.\tGT\t0\t1/1\n" for i in range(1, 200))
    (tmp_path / "a.vcf").write_text(head + columns + body)
    table = vcf.read_vcf(spark, str(tmp_path / "a.vcf"))
    bcf.write_bcf(table.repartition(3), str(tmp_path / "out"), head + columns)
    back = bcf.read_bcf(spark, str(tmp_path / "out"))
    assert back.rdd.getNumPartitions() == 3
    rows = lambda t: sorted(str(r.asDict(recursive=True)) for r in t.collect())
    assert rows(back.select(*table.columns)) == rows(table)
    vcf.reheader(spark, str(tmp_path / "a.vcf"), ["##new=1", columns.rstrip("\n")], str(tmp_path / "re"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "re").glob("part-*")))
    assert lines == "##new=1\n" + columns + body
    vcf.write_vcf(table, (head + columns).splitlines(), ["A", "B"], str(tmp_path / "w"))
    written = [x for p in sorted((tmp_path / "w").glob("part-*")) for x in p.read_text().splitlines()]
    assert written[: len(head.splitlines())] == head.splitlines() and len(written) == len(head.splitlines()) + 201
