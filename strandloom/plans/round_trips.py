"""Queries that write derived tables in a file format and read them back, and queries over
headers, fields and filters; each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alignment as A
from ..functions import statistics as ST
from ..operators import beta as B
from ..operators import haplotypes as H
from ..operators import pileup as P
from ..operators import regions as R
from ..operators import summary as M
from ..operators import variants as V
from ..sources import bam, bcf, sam, sequences, text
from ..sources import variants as vcf
from ..sources.lines import numbered_lines
from ..sources.scratch import scratch_path
from . import derived as D
from .oracles import _ALN, _BED, _HAPS, _MEASURED, _MEASURES, _VAR, _beta_sites

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return keep


def _in_order(spark: SparkSession, path: str) -> DataFrame:
    """place and value of the lines of a folder's parts, one after the other."""
    from ..operators.convert import global_index

    lines = numbered_lines(spark, path)
    part = F.regexp_extract("file", r"part-(\d+)", 1).cast("bigint")
    return global_index(lines.select((part * (1 << 32) + F.col("n")).alias("at"), "value"), "at").select(F.col("idx").alias("place"), "value")


@query(f'WITH {_HAPS} SELECT chr, beg, "end", hap, cnt, strand FROM haps')
def haplotype_files(spark, d):
    path = scratch_path(spark, "haps") + ".mhap.gz"
    text.write_haplotypes(D.haplotypes(spark, d), path)
    return text.read_haplotypes(spark, path)


_HAP_LINE = """chr || chr(9) || beg || chr(9) || "end" || chr(9) || hap || chr(9) || cnt || chr(9) || strand"""


@query(f'WITH {_HAPS} SELECT row_number() OVER (ORDER BY chr, beg, "end", hap, cnt, strand) - 1 AS place, {_HAP_LINE} AS value FROM haps')
def haplotype_file_order(spark, d):
    path = scratch_path(spark, "haps") + ".mhap"
    text.write_haplotypes(D.haplotypes(spark, d), path)
    return _in_order(spark, path)


@query(f"""WITH {_HAPS}, g AS (SELECT chr, beg, "end", hap, strand, sum(cnt) AS cnt FROM haps GROUP BY ALL)
SELECT row_number() OVER (ORDER BY chr DESC, beg, "end", hap, strand) - 1 AS place, {_HAP_LINE} AS value FROM g""")
def haplotype_header_order(spark, d):
    """Chromosomes in the order of a header that lists them backwards."""
    path = scratch_path(spark, "haps") + ".mhap"
    text.write_haplotypes(H.merge(D.haplotypes(spark, d, 0), D.haplotypes(spark, d, 1)), path, [f"chr{i}" for i in range(4, -1, -1)])
    return _in_order(spark, path)


@query(f"""WITH b AS ({_beta_sites("strand")})
SELECT row_number() OVER (ORDER BY chr, pos, strand) - 1 AS place, concat_ws(chr(9), chr, pos, "end", pct, meth, unmeth, strand) AS value FROM b""")
def beta_file_order(spark, d):
    path = scratch_path(spark, "beta")
    text.write_beta(B.beta(D.haplotypes(spark, d), D.sites(spark, d), stranded=True), path)
    return _in_order(spark, path)


@query(f"""WITH {_MEASURED}, {_BED},
s AS (
  SELECT b.ord, b.chr, b.beg + 1 AS beg, b."end", '*' AS strand, min(b.ord) OVER (PARTITION BY b.chr) AS first, m.*
  FROM bed b LEFT JOIN (SELECT b.ord AS o, {_MEASURES} FROM bed b LEFT JOIN measured m ON m.chr = b.chr AND m.beg <= b."end" AND m."end" >= b.beg + 1 GROUP BY 1) m ON m.o = b.ord
)
SELECT row_number() OVER (ORDER BY first, ord) - 1 AS place, concat_ws(chr(9), chr, beg, "end", strand, nReads, mBase, tBase, cBase, K4plus, nDR, nMR) AS value FROM s""")
def summary_file_order(spark, d):
    """The rows without their header, which each part has."""
    path = scratch_path(spark, "summary")
    text.write_summary(M.summary_regions(D.haplotypes(spark, d), R.bed_to_closed(D.bed(spark, d))), path)
    from ..operators.convert import global_index

    rows = _in_order(spark, path).where(~F.col("value").startswith("Chr\t"))
    return global_index(rows, "place").select(F.col("idx").alias("place"), "value")


@query(f"""WITH {_HAPS} SELECT chr, beg, "end", hap, cnt, strand FROM haps WHERE chr = 'chr1' AND beg <= 9000 AND "end" >= 1500""")
def haplotype_range_scan(spark, d):
    path = scratch_path(spark, "clustered")
    text.store_clustered(D.haplotypes(spark, d), path)
    return text.scan_range(spark, path, "chr1", 1500, 9000)


@query(f"WITH {_HAPS} SELECT chr, pos, rk FROM sites WHERE chr = 'chr2' AND pos BETWEEN 700 AND 5000")
def site_range_scan(spark, d):
    path = scratch_path(spark, "clustered")
    text.store_clustered(D.sites(spark, d), path, "pos")
    return text.scan_range(spark, path, "chr2", 700, 5000, "pos", "pos")


@query(f'WITH {_BED} SELECT chr, beg, "end" FROM bed')
def bed_file(spark, d):
    path = scratch_path(spark, "regions") + ".bed"
    D.bed(spark, d).select(F.concat_ws("\t", "chr", "beg", "end", F.concat(F.lit("name"), "ord")).alias("value")).write.text(path)
    return text.read_bed(spark, path).select("chr", "beg", "end")


@query(f"""WITH {_BED} SELECT ord, chr, beg, "end" FROM (
  SELECT ord, chr, CASE WHEN ord % 3 = 0 THEN 0 ELSE beg END AS beg, CASE WHEN ord % 3 = 0 THEN 9223372036854775807 WHEN ord % 3 = 1 THEN beg + 1 ELSE "end" END AS "end" FROM bed)""")
def region_file(spark, d):
    """Lines name, name:n and name:n-m; the payload's number comes by a parser of one's own."""
    path = scratch_path(spark, "regions") + ".reg"
    line = F.when(F.col("ord") % 3 == 0, F.col("chr")).when(F.col("ord") % 3 == 1, F.concat_ws(":", "chr", F.col("beg") + 1)).otherwise(F.concat("chr", F.lit(":"), F.col("beg") + 1, F.lit("-"), "end"))
    D.bed(spark, d).orderBy("ord").coalesce(1).select(line.alias("value")).write.text(path)
    numbers = D.bed(spark, d).select("ord", line.alias("line"))
    whole = text.read_regions(spark, path, "reg").select("chr", "beg", "end")
    end = F.when(F.col("ord") % 3 == 0, F.lit((1 << 63) - 1)).when(F.col("ord") % 3 == 1, F.regexp_extract("line", r":(\d+)", 1).cast("bigint")).otherwise(F.regexp_extract("line", r"-(\d+)", 1).cast("bigint"))
    keyed = numbers.select("ord", F.substring_index("line", ":", 1).alias("_c"), F.when(F.col("ord") % 3 == 0, 0).otherwise(F.regexp_extract("line", r":(\d+)", 1).try_cast("bigint") - 1).alias("_b"), end.alias("_e")).distinct()
    return whole.distinct().join(keyed, (F.col("chr") == F.col("_c")) & (F.col("beg") == F.col("_b")) & (F.col("end") == F.col("_e"))).select("ord", "chr", "beg", "end")


def _with_mates(spark, d):
    """The alignments with mates and optional fields."""
    tags = F.map_filter(F.create_map(F.lit("XM"), F.concat(F.lit("Z:"), "xm"), F.lit("NM"), F.concat(F.lit("i:"), F.col("ord") % 7), F.lit("ZF"), F.lit("f:0.5"), F.lit("ZB"), F.concat(F.lit("B:s,1,"), F.col("ord") % 5)), lambda _, v: v.isNotNull())
    return D.alignments(spark, d).withColumns({"mchr": F.when(F.col("ord") % 2 == 0, F.col("chr")).otherwise("*"), "mpos": F.when(F.col("ord") % 2 == 0, F.col("pos") + 9).otherwise(-1).cast("bigint"), "tlen": (F.col("ord") % 50 - 25).cast("bigint"), "aux": tags})


@query(f"""WITH {_ALN} SELECT qname, flag, chr, pos, cigar, CASE WHEN ord % 2 = 0 THEN chr ELSE '*' END AS mchr, CASE WHEN ord % 2 = 0 THEN pos + 9 ELSE -1 END AS mpos, CAST(ord % 50 - 25 AS BIGINT) AS tlen,
  seq, qual, xm, CASE WHEN xm IS NOT NULL THEN 'Z' END AS xm_type, ord % 7 AS nm, 0.5 :: DOUBLE AS zf, ord % 5 AS zb, 'f:0.5' AS raw FROM aln""")
def sam_round_trip(spark, d):
    path = scratch_path(spark, "sam")
    sam.write_sam(_with_mates(spark, d), path)
    a = F.col("aux")
    fields = [A.aux_int(a, "NM").alias("nm"), A.aux_float(a, "ZF").alias("zf"), A.aux_array(a, "ZB")[1].cast("bigint").alias("zb"), F.element_at(a, "ZF").alias("raw")]
    return sam.read_sam(spark, path).select("qname", "flag", "chr", "pos", "cigar", "mchr", "mpos", "tlen", "seq", "qual", "xm", "xm_type", *fields)


@query(f"""WITH {_ALN} SELECT ord % 7 + 1 AS nm, CASE WHEN ord % 3 = 0 THEN 'Z:new' END AS co, xm IS NOT NULL AS kept FROM aln""")
def aux_updates(spark, d):
    a = F.col("aux")
    new = A.aux_set(a, "NM", "i", A.aux_int(a, "NM") + 1)
    new = F.when(F.col("ord") % 3 == 0, A.aux_set(new, "CO", "Z", F.lit("new"))).otherwise(A.aux_drop(new, "ZB"))
    cut = _with_mates(spark, d).select("ord", new.alias("aux"))
    return cut.select(A.aux_int(a, "NM").alias("nm"), F.element_at(a, "CO").alias("co"), F.array_contains(F.map_keys(a), "XM").alias("kept"))


@query(f"WITH {_ALN} SELECT qname, flag, pos, cigar, seq FROM aln WHERE chr = 'chr2' AND pos < 6000 AND pos + rlen > 2500")
def bam_region_reads(spark, d):
    """A sorted folder of BAM files, each with its index, read by region."""
    path = scratch_path(spark, "bam")
    head = "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:chr{i}\tLN:1000000\n" for i in range(5))
    ranged = _with_mates(spark, d).repartitionByRange(4, "chr", "pos").sortWithinPartitions("chr", "pos")
    bam.write_bam(ranged, path, head)
    for part, _ in bam._files(path):
        bam.index_bam(spark, part)
    return bam.read_bam(spark, path, ("chr2", 2500, 6000)).select("qname", "flag", "pos", "cigar", "seq")


@query(f"WITH {_ALN} SELECT qname || '/' || (ord % 2) AS qname, ord FROM aln")
def query_names(spark, d):
    return sam.set_query_name(D.alignments(spark, d), F.concat_ws("/", "qname", F.col("ord") % 2)).select("qname", "ord")


@query(f"WITH {_ALN} SELECT ord FROM aln WHERE (flag & 3844) = 0 AND ord % 7 > 1")
def aln_empty_sequences(spark, d):
    seq = F.when(F.col("ord") % 7 == 0, "").when(F.col("ord") % 7 == 1, "*").otherwise(F.col("seq"))
    return D.alignments(spark, d).withColumn("seq", seq).where(A.usable(F.col("flag"), F.col("seq"))).select("ord")


@query(f"""WITH {_ALN}, u AS (SELECT ord % 3 AS s, chr, unnest(range(pos + 1, pos + rlen + 1)) AS position FROM aln WHERE (flag & 3844) = 0)
SELECT chr, position, count(*) FILTER (s = 0) AS s0, count(*) FILTER (s = 1) AS s1, count(*) FILTER (s = 2) AS s2 FROM u GROUP BY 1, 2""")
def sample_depths(spark, d):
    reads = D.alignments(spark, d).withColumn("sample", F.concat(F.lit("s"), F.col("ord") % 3))
    return P.sample_depths(reads, "sample", ["s0", "s1", "s2"])


_RECORDS = f"""{_VAR},
r AS (
  SELECT id, chr, pos, CASE WHEN id % 4 > 0 THEN 'rs' || id END AS name, ref, CASE WHEN id % 23 IN (0, 2, 4) THEN 'T' ELSE upper(replace(replace(alt, '<X>', 'G'), '.', 'C')) END AS alt,
    CASE WHEN id % 5 > 0 THEN CAST(id % 90 AS DOUBLE) END AS qual, CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN 'PASS' ELSE 'q10,s50' END AS filters FROM vars
)"""


def _records(spark, d):
    """Variant records with all the columns of read_vcf, two samples and typed fields."""
    i = F.col("id")
    alt = F.when((i % 23).isin(0, 2, 4), "T").otherwise(F.upper(F.replace(F.replace("alt", F.lit("<X>"), F.lit("G")), F.lit("."), F.lit("C"))))
    empty = F.expr("cast(array() as array<string>)")
    filters = F.when(i % 3 == 0, empty).when(i % 3 == 1, F.array(F.lit("PASS"))).otherwise(F.array(F.lit("q10"), F.lit("s50")))
    info = F.map_filter(F.create_map(F.lit("DP"), (i % 50).cast("string"), F.lit("AF"), F.lit("0.25"), F.lit("DB"), F.when(i % 2 == 0, "")), lambda _, v: v.isNotNull())
    one = lambda s: F.create_map(F.lit("GT"), F.concat_ws("/", (i + s) % 2, F.lit("1")), F.lit("PL"), F.concat_ws(",", i % 9, F.lit("."), F.lit(s)))
    return D.variants(spark, d).select(
        "chr", "pos", F.when(i % 4 > 0, F.concat(F.lit("rs"), i)).alias("id"), "ref", F.array(alt).alias("alts"), F.when(i % 5 > 0, (i % 90).cast("double")).alias("qual"), filters.alias("filters"),
        info.alias("info"), F.create_map(F.lit("A"), one(0), F.lit("B"), one(1)).alias("samples"), i.alias("number"),
    )


_HEAD = ["##fileformat=VCFv4.2", '##FILTER=<ID=q10,Description="x">', '##FILTER=<ID=s50,Description="x">', *[f"##contig=<ID=chr{i}>" for i in range(5)], '##INFO=<ID=DP,Number=1,Type=Integer,Description="x">', '##INFO=<ID=AF,Number=A,Type=Float,Description="x">', '##INFO=<ID=DB,Number=0,Type=Flag,Description="x">', '##FORMAT=<ID=GT,Number=1,Type=String,Description="x">', '##FORMAT=<ID=PL,Number=G,Type=Integer,Description="x">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB"]
_READ_SQL = f"""WITH {_RECORDS} SELECT chr, pos, name AS id, ref, alt, qual, filters, CAST(id % 50 AS INTEGER) AS dp, 0.25 :: DOUBLE AS af, id % 2 = 0 AS db, (id % 2) || '/1' AS gt_a, ((id + 1) % 2) || '/1' AS gt_b, (id % 9) || ',.,1' AS pl_b,
  CAST(pos - 1 AS BIGINT) AS beg, CAST(pos - 1 + length(ref) AS BIGINT) AS "end" FROM r"""


def _read_back(found: DataFrame) -> DataFrame:
    info, get = F.col("info"), lambda s, k: F.col("samples")[s][k]
    beg, end = vcf.record_span(F.col("pos"), F.col("ref"), info)
    return found.select(
        "chr", "pos", "id", "ref", F.array_join("alts", ",").alias("alt"), "qual", F.array_join("filters", ",").alias("filters"), vcf.typed_info(info, "DP", "Integer", "1").alias("dp"), vcf.typed_info(info, "AF", "Float", "A")[0].alias("af"),
        vcf.typed_info(info, "DB", "Flag", "0").alias("db"), get("A", "GT").alias("gt_a"), get("B", "GT").alias("gt_b"), get("B", "PL").alias("pl_b"), beg.cast("bigint").alias("beg"), end.cast("bigint").alias("end"),
    )


@query(_READ_SQL)
def vcf_round_trip(spark, d):
    path = scratch_path(spark, "vcf")
    vcf.write_vcf(_records(spark, d).drop("number"), _HEAD, ["A", "B"], path)
    return _read_back(vcf.read_vcf(spark, path))


@query(_READ_SQL)
def bcf_round_trip(spark, d):
    path = scratch_path(spark, "bcf")
    bcf.write_bcf(_records(spark, d), path, "\n".join(_HEAD) + "\n")
    return _read_back(bcf.read_bcf(spark, path))


@query(f"""WITH {_RECORDS} SELECT id AS number, CASE WHEN name IS NULL THEN 'x' || id % 2 ELSE name || ';x' || id % 2 END AS name, CAST(id % 50 + 1 AS VARCHAR) AS dp, false AS db, '7' AS q_a, '.' AS q_b, 1 AS samples,
  CASE id % 3 WHEN 2 THEN 'q10,s50,new' ELSE 'new' END AS added, CASE id % 3 WHEN 0 THEN 'PASS' WHEN 1 THEN 'PASS' ELSE 's50' END AS removed, id % 3 < 2 AS passes FROM r""")
def record_updates(spark, d):
    info, f = F.col("info"), F.col("filters")
    dp = V.set_info(V.set_info(info, "DP", F.element_at(info, "DP").cast("int") + 1), "DB", None)
    samples = V.set_format(F.col("samples"), "Q", F.create_map(F.lit("A"), F.lit("7")))
    return _records(spark, d).select(
        "number", V.add_id(F.col("id"), F.concat(F.lit("x"), F.col("number") % 2)).alias("name"), F.element_at(dp, "DP").alias("dp"), F.array_contains(F.map_keys(dp), "DB").alias("db"), samples["A"]["Q"].alias("q_a"), samples["B"]["Q"].alias("q_b"),
        F.size(vcf.keep_samples(samples, ["B"])).alias("samples"), F.array_join(V.add_filter(f, "new"), ",").alias("added"), F.array_join(V.remove_filter(f, "q10"), ",").alias("removed"), V.has_filter(f, F.lit("PASS")).alias("passes"),
    )


@query("""WITH lines AS (SELECT p_partkey AS k, substr(repeat('ACGTTGCATA', 7), CAST(1 + p_partkey % 9 AS BIGINT), 60) AS a, substr(repeat('GGATC', 12), 1, CAST(p_partkey % 60 AS BIGINT)) AS b FROM part),
r AS (SELECT s_suppkey AS k, s_suppkey % 50 AS beg, s_suppkey % 50 + 40 AS "end" FROM supplier)
SELECT r.k AS ord, 's' || r.k AS chr, r.beg, r."end", substr(a || b, CAST(beg + 1 AS BIGINT), CAST(40 AS BIGINT)) AS seq, length(a || b) AS whole FROM r JOIN lines l ON l.k = r.k WHERE length(a || b) > beg""")
def fasta_fetch(spark, d):
    path = scratch_path(spark, "fasta")
    k = F.col("p_partkey")
    value = F.concat(F.lit(">s"), k, F.lit(" x\n"), F.substr(F.repeat(F.lit("acgttGCATA"), 7), (1 + k % 9).cast("int"), F.lit(60)), F.lit("\n"), F.substr(F.repeat(F.lit("GGATC"), 12), F.lit(1), (k % 60).cast("int")))
    D.table(spark, d, "part").select(value.alias("value")).write.text(path)
    chunks = sequences.read_fasta(spark, path)
    s = F.col("s_suppkey")
    wanted = D.table(spark, d, "supplier").select(s.alias("ord"), F.concat(F.lit("s"), s).alias("chr"), (s % 50).alias("beg"), (s % 50 + 40).alias("end"))
    sizes = sequences.lengths(chunks).select("name", F.col("length").alias("whole"))
    return sequences.fetch(chunks, wanted).join(sizes, F.col("chr") == F.col("name")).drop("name")


_NATIONS = "n AS (SELECT n_nationkey AS k, 'n' || n_nationkey AS id, n_regionkey AS r FROM nation)"


@query(f"""WITH {_NATIONS}
SELECT '@SQ' || chr(9) || 'SN:' || id || chr(9) || 'LN:' || CASE WHEN k = 3 THEN 'new' WHEN k < 15 THEN CAST(100 + k AS VARCHAR) ELSE CAST(900 + k AS VARCHAR) END AS value FROM n WHERE k <> 4
UNION ALL SELECT '@HD' || chr(9) || 'VN:1.6'
UNION ALL SELECT '@PG' || chr(9) || 'ID:z'
UNION ALL SELECT '@PG' || chr(9) || 'ID:y' || chr(9) || 'PP:z'""")
def sam_header_edits(spark, d):
    """Two headers merged (the first one's lines stay), a line changed, one removed, one renamed,
    and a program added to the chain."""
    k = F.col("n_nationkey")
    lines = lambda base: F.concat(F.lit("@SQ\tSN:n"), k, F.lit("\tLN:"), k + base)
    table = D.table(spark, d, "nation")
    top = spark.createDataFrame([("@HD\tVN:1.6", 100), ("@PG\tID:x", 200)], "value string, line bigint")
    one = sam.parse_header(table.where("n_nationkey < 15").select(lines(100).alias("value"), k.cast("bigint").alias("line")).unionByName(top))
    two = sam.parse_header(table.where("n_nationkey >= 10").select(lines(900).alias("value"), k.cast("bigint").alias("line")))
    head = sam.merge_headers(one, two)
    head = sam.update_header(head, "SQ", "SN", "n3", {"LN": "new"})
    head = sam.add_header_line(sam.remove_header_lines(head, "SQ", "SN", "n4"), "PG", {"ID": "y"})
    tags = F.transform(F.array_sort(F.map_entries("tags"), lambda a, b: F.when(a["key"].isin("SN", "ID") | (b["key"] == "PP"), -1).otherwise(1)), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    return sam.rename_header_line(head, "PG", "ID", "x", "z").select(F.concat_ws("\t", F.concat(F.lit("@"), "type"), F.array_join(tags, "\t")).alias("value"))


@query(f"""WITH {_NATIONS}, e AS (
  SELECT k, 'INFO' AS kind, id, CASE WHEN k % 2 = 0 THEN 'A' ELSE '1' END AS number, 0 AS f FROM n WHERE k < 15
  UNION ALL SELECT k, 'INFO', id, '1', 1 FROM n WHERE k >= 10
)
SELECT kind, id, min_by(number, f) AS number, count(DISTINCT number) > 1 AS conflict FROM e GROUP BY kind, id""")
def vcf_header_merge(spark, d):
    k = F.col("n_nationkey")
    line = lambda number: F.concat(F.lit("##INFO=<ID=n"), k, F.lit(",Number="), number, F.lit(',Type=Integer,Description="x">'))
    table = D.table(spark, d, "nation")
    one = table.where("n_nationkey < 15").select(line(F.when(k % 2 == 0, "A").otherwise("1")).alias("value"), k.cast("bigint").alias("line"))
    two = table.where("n_nationkey >= 10").select(line(F.lit("1")).alias("value"), k.cast("bigint").alias("line"))
    return vcf.merge_headers(vcf.header_table(one), vcf.header_table(two)).select("kind", "id", "number", "conflict")


@query("""SELECT p_partkey, round(lgamma(p_partkey + 0.5), 6) AS lg, round(1 - exp(-(p_partkey % 13) / 3.0), 9) AS gp, round(exp(-(p_partkey % 13) / 3.0), 9) AS gq,
  round(1 - pow(1 - (p_partkey % 11) / 10.0, 1 + p_partkey % 5), 9) AS bi, round(lgamma(p_partkey + 1.0), 6) AS lf FROM part""")
def special_functions(spark, d):
    """Where the incomplete functions have a closed form: gamma of 1, beta of 1 and b."""
    k = F.col("p_partkey")
    z, x = (k % 13) / 3.0, (k % 11) / 10.0
    one = F.lit(1.0)
    return D.table(spark, d, "part").select(
        "p_partkey", F.round(ST.log_gamma(k + 0.5), 6).alias("lg"), F.round(ST.gamma_p(one, z), 9).alias("gp"), F.round(ST.gamma_q(one, z), 9).alias("gq"), F.round(ST.beta_inc(one, (1 + k % 5).cast("double"), x), 9).alias("bi"), F.round(ST.log_factorial(k), 6).alias("lf"),
    )


@query(f"""WITH {_BED} SELECT ord, chr, beg, "end", row_number() OVER (PARTITION BY chr ORDER BY beg, "end" DESC, ord) AS turn FROM bed""")
def region_list_order(spark, d):
    """Regions in the order of a list: begin ascending, the longer first."""
    from pyspark.sql import Window

    listed = R.listed(D.bed(spark, d))
    return listed.withColumn("turn", F.row_number().over(Window.partitionBy("chr").orderBy("beg", F.desc("end"), "ord"))).select("ord", "chr", "beg", "end", "turn")


@query("""WITH l AS (SELECT string_agg('chr' || (n_nationkey % 7), ',' ORDER BY n_nationkey) AS t FROM nation) SELECT unnest(string_split(t, ',')) AS name FROM l""")
def name_lists(spark, d):
    """A comma list of names."""
    names = D.table(spark, d, "nation").orderBy("n_nationkey").select(F.concat(F.lit("chr"), F.col("n_nationkey") % 7).alias("n"))
    return text.read_list(spark, ",".join(r["n"] for r in names.collect()))  # 25 nations


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
