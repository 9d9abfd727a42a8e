"""Command line: convert, merge, beta and summary over files."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.regions import parse_region, parse_summary_region
from ..operators import beta as B
from ..operators import convert as C
from ..operators import haplotypes as H
from ..operators import regions as R
from ..operators import summary as M
from ..sources import bam, sam, text
from ..sources.detect import detect_format


#: Bases that a read may have more than it spans on the reference.
READ_SPAN = 1 << 20


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandloom", description="DNA-methylation haplotypes on Spark")
    sub = top.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert", help="alignments to haplotypes")
    c.add_argument("-i", required=True)
    c.add_argument("-c", required=True)
    c.add_argument("-r")
    c.add_argument("-b")
    c.add_argument("-n", action="store_true", help="non-directional reads")
    c.add_argument("-m", choices=["BS", "TAPS"], default="BS")
    c.add_argument("-o", default="out.mhap.gz")
    m = sub.add_parser("merge", help="merge haplotype files")
    m.add_argument("-i", nargs="+", required=True)
    m.add_argument("-c")
    m.add_argument("--mode", choices=["grouped", "adjacent"], default="grouped")
    m.add_argument("-o", default="merged.mhap.gz")
    b = sub.add_parser("beta", help="methylation of sites or regions")
    b.add_argument("-i", required=True)
    b.add_argument("-c", required=True)
    b.add_argument("-b")
    b.add_argument("-s", action="store_true")
    b.add_argument("-o", default="beta.txt")
    s = sub.add_parser("summary", help="read-level measures")
    s.add_argument("-i", required=True)
    s.add_argument("-c")
    s.add_argument("-r")
    s.add_argument("-b")
    s.add_argument("-g", action="store_true")
    s.add_argument("-s", action="store_true")
    s.add_argument("-o")
    return top


def _one_region(spark: SparkSession, name: str, beg: int, end: int) -> DataFrame:
    return spark.createDataFrame([(-1, name, beg, end)], "ord bigint, chr string, beg bigint, end bigint")


def _is_bam(path: str) -> bool:
    """By a file's first bytes; by its name where Spark alone can read it, or for a folder."""
    try:
        with bam.open_file(path) as stream:
            return detect_format(stream.read(1 << 16))[0] == "bam"
    except (OSError, ValueError):
        return path.rstrip("/").endswith(".bam")


def _reads(spark: SparkSession, path: str, binary: bool, region: tuple[str, int, int] | None) -> DataFrame:
    """Alignments; of an indexed file those that may meet the region: a read meets it by its bases
    here, and by its reference span in the index, so the region is read with room before it."""
    if not binary:
        return sam.read_sam(spark, path)
    return bam.read_bam(spark, path, region and (region[0], max(0, region[1] - READ_SPAN), region[2]))


def run(spark: SparkSession, argv: list[str]) -> None:
    a = _parser().parse_args(argv)
    if a.command == "convert":
        if a.r and a.b:
            raise ValueError("give -r or -b, not both")
        binary = _is_bam(a.i)
        regions = region = None
        # the sequences that the header names, in its order
        listed = None if binary else sam.find_header_lines(sam.read_header(spark, a.i), "SQ").select(F.element_at("tags", "SN").alias("name"))
        names = [n for n, _ in bam.read_header(a.i)[1]] if binary else [r["name"] for r in listed.collect()]
        if a.r:
            name, beg, end, _ = parse_region(a.r, names)
            region = (name, beg, min(end, 1 << 40))
            regions = _one_region(spark, name, beg + 1, end)
        elif a.b:
            regions = R.bed_to_closed(text.read_bed(spark, a.b))
        reads = _reads(spark, a.i, binary, region)
        text.write_haplotypes(C.convert(reads, text.read_sites(spark, a.c), regions, not a.n, a.m), a.o, names)
    elif a.command == "merge":
        if len(a.i) < 2:
            raise ValueError("merge needs at least two inputs")
        text.write_haplotypes(H.merge(*[text.read_haplotypes(spark, p) for p in a.i], mode=a.mode), a.o)
    elif a.command == "beta":
        bed = text.read_bed(spark, a.b) if a.b else None
        text.write_beta(B.beta(text.read_haplotypes(spark, a.i), text.read_sites(spark, a.c), bed, a.s), a.o)
    else:
        if a.g and not a.c:
            raise ValueError("-g needs -c")
        if not (a.g or a.r or a.b):
            raise ValueError("give -b, -r or -g")
        table = text.read_haplotypes(spark, a.i)
        if a.g:
            text.write_summary(M.summary_genome(table, text.read_sites(spark, a.c), a.s), a.o or "summary_genome_wide.txt")
            return
        wanted = []
        if a.r:
            wanted.append(_one_region(spark, *parse_summary_region(a.r)))
        if a.b:
            wanted.append(R.bed_to_closed(text.read_bed(spark, a.b)).select("ord", "chr", "beg", "end"))
        regions = wanted[0] if len(wanted) == 1 else wanted[0].unionByName(wanted[1])
        text.write_summary(M.summary_regions(table, regions, a.s).withColumn("ord", F.col("ord")), a.o or "summary.txt")


def main() -> None:
    started = time.time()
    run(SparkSession.builder.appName("strandloom").getOrCreate(), sys.argv[1:])
    print(f"{time.time() - started:.1f} s", file=sys.stderr)


if __name__ == "__main__":
    main()
