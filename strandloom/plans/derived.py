"""Genomics tables derived by arithmetic from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def site_position(rank: str) -> str:
    return f"100 + 37 * ({rank}) + (({rank}) * ({rank})) % 11"


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chr, pos, rk from part."""
    return table(spark, sf_dir, "part").selectExpr("concat('chr', p_partkey % 5) AS chr", "p_partkey div 5 AS rk").selectExpr("chr", f"{site_position('rk')} AS pos", "rk")


def raw_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites(spark, sf_dir).select("chr", "pos")


def haplotypes(spark: SparkSession, sf_dir: str, half: int | None = None) -> DataFrame:
    """chr, beg, end, hap, cnt, strand from lineitem; ``half`` keeps rows by order parity."""
    last = sites(spark, sf_dir).groupBy(F.col("chr").alias("m_chr")).agg(F.max("rk").alias("max_rk"))  # one row a chromosome
    lines = table(spark, sf_dir, "lineitem")
    if half is not None:
        lines = lines.where(F.col("l_orderkey") % 2 == half)
    rows = lines.selectExpr(
        "concat('chr', l_partkey % 5) AS chr", "l_partkey div 5 AS rk", "1 + cast(l_quantity AS int) % 8 AS want", "l_orderkey * 31 + l_linenumber * 7 AS v", "l_linenumber AS cnt", "CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand"
    )
    rows = rows.join(F.broadcast(last), F.col("chr") == F.col("m_chr")).withColumn("len", F.expr("cast(least(want, max_rk - rk + 1) AS int)"))
    return rows.selectExpr("chr", f"{site_position('rk')} AS beg", f"{site_position('rk + len - 1')} AS end", "substr(reverse(lpad(bin(v % 256), 8, '0')), 1, len) AS hap", "cnt", "strand")


def bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, chr, beg, end (BED: 0-based, half-open) from supplier; some past the last site,
    some on a chromosome without sites."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS ord", "concat('chr', s_suppkey % 6) AS chr",
        "CASE WHEN s_suppkey % 10 = 9 THEN 10000000 + s_suppkey ELSE (s_suppkey * 977) % 14000 END AS beg", "s_suppkey % 400 AS w",
    ).selectExpr("ord", "chr", "beg", "beg + 60 + w * 13 % 900 AS end")


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reads an order: ord, qname, flag, chr, pos (0-based), mapq, cigar, seq, qual, xm."""
    k = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "CASE WHEN o_orderkey % 97 = 1 THEN o_orderkey - 1 ELSE o_orderkey END AS q")
    reads = k.withColumn("mate", F.explode(F.array(F.lit(0), F.lit(1))))
    reads = reads.selectExpr(
        "k * 2 + mate AS ord", "concat('q', q) AS qname", "concat('chr', q % 5) AS chr", "k", "mate",
        """CASE WHEN k % 31 = 0 THEN 1 WHEN k % 13 = 0 THEN 16 * (k % 2)
             WHEN k % 29 = 0 THEN 67 WHEN k % 2 = 0 THEN 99 + mate * 48 ELSE 83 + mate * 80 END
           + CASE WHEN k % 50 = 7 THEN 1024 ELSE 0 END AS flag""",
        "90 + 37 * ((q div 5) % 380) + k % 23 + mate * (k % 60) AS pos", "40 + k % 50 AS len", "k % 6 AS v",
    )
    minus = "(flag & 1023) IN (16, 83, 163)"
    pattern = f"CASE WHEN {minus} THEN element_at(array('GGAA', 'GAGA', 'AAGG', 'AGAG', 'GGGA', 'GGCA'), cast(v + 1 AS int)) ELSE element_at(array('CCTT', 'CTCT', 'TTCC', 'TCTC', 'CCCT', 'CCAT'), cast(v + 1 AS int)) END"
    return reads.selectExpr(
        "ord", "qname", "cast(flag AS int) AS flag", "chr", "pos", "cast(k % 60 AS int) AS mapq",
        "concat(5 + k % 4, 'S', len - 12 - k % 4, 'M', 1 + k % 3, 'I', 3 - k % 3, 'M', k % 5 + 1, 'D', 3, 'M') AS cigar",
        f"substr(repeat({pattern}, 30), cast(1 + pos % 4 AS int), cast(len AS int)) AS seq",
        "CASE WHEN k % 41 = 0 THEN '*' ELSE substr(repeat('!5?I+', 30), cast(1 + k % 5 AS int), cast(len AS int)) END AS qual",
        "CASE WHEN k % 17 = 0 THEN 'zzXh' WHEN k % 17 = 1 THEN 'zzh.' END AS xm",
    )


def far_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignments in another order: of every third name the second mates come some 1,400
    reads later."""
    moved = "(ord % 2 = 1 AND (ord div 2) % 3 = 0)"
    return alignments(spark, sf_dir).withColumn("ord", F.expr(f"CASE WHEN {moved} THEN (ord + 1400) * 4 + 1 ELSE ord * 4 END"))


def region_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and region from supplier, in all the ways to write one."""
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "concat('chr', s_suppkey % 5) AS c", "310 + s_suppkey % 677 AS a").selectExpr(
        "id",
        """CASE id % 6 WHEN 0 THEN c WHEN 1 THEN concat(c, ':', a) WHEN 2 THEN concat(c, ':', a, '-', a + 283) WHEN 3 THEN concat(c, ':-', a)
             WHEN 4 THEN concat(c, ':7,', a, '-8,', a) ELSE concat('{', c, '}:', a, 'k-', a + 1, '.5K') END AS region""",
    )


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, chr, pos, ref, alt from part."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", "concat('chr', p_partkey % 5) AS chr", "100 + 37 * (p_partkey div 5) AS pos",
        "substr('ACGTTACG', cast(1 + p_partkey % 4 AS int), cast(1 + p_partkey % 3 AS int)) AS ref",
        "CASE p_partkey % 23 WHEN 0 THEN '*' WHEN 1 THEN '<X>' WHEN 2 THEN '<DEL>' WHEN 3 THEN '.' WHEN 4 THEN concat(substr('ACGTTACG', cast(1 + p_partkey % 4 AS int), cast(1 + p_partkey % 3 AS int)), ']chr1:5]') ELSE substr('acGTCAGTTACC', cast(1 + p_partkey % 7 AS int), cast(1 + p_partkey % 4 AS int)) END AS alt",
    )


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """variant, sample, gt from lineitem."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_partkey AS variant", "l_orderkey AS sample", "l_suppkey AS s", "l_linenumber AS n", "l_extendedprice AS price",
        "CASE WHEN (l_orderkey + l_linenumber) % 11 = 0 THEN '.' WHEN (l_orderkey + l_linenumber) % 11 = 1 THEN cast(l_suppkey % 3 AS string) WHEN (l_orderkey + l_linenumber) % 11 = 2 THEN concat('./', l_suppkey % 2) ELSE concat(l_suppkey % 3, '/', l_orderkey % 3) END AS gt",
    )
