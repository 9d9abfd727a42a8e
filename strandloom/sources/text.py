"""Readers and writers of the tab-delimited tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.regions import detect_region_format
from ..schema import HAPLOTYPE, SUMMARY_COLUMNS


def _suffixed(path: str, *endings: str) -> str:
    if not path.rstrip("/").endswith(endings):
        raise ValueError(f"{path}: expected a name ending in {' or '.join(endings)}")
    return path


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Non-blank lines that are no comments, with ``ord`` in file order."""
    lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())
    return lines.where((F.trim("value") != "") & ~F.col("value").startswith("#"))


def read_haplotypes(spark: SparkSession, *paths: str) -> DataFrame:
    """Haplotype files (.mhap.gz or plain): six tab-separated fields; a line without its
    strand is an error.  A gzip file is one split, so the rows are spread after reading."""
    table = spark.read.csv(list(paths), sep="\t", schema=HAPLOTYPE, quote="", comment="#", mode="FAILFAST")
    strand = F.substr("strand", F.lit(1), F.lit(1))
    table = table.withColumn("strand", F.when(F.col("strand").isNull(), F.raise_error(F.concat(F.lit("no strand after "), F.coalesce("hap", F.lit("?"))))).otherwise(strand))
    return table.repartition("chr", F.floor(F.col("beg") / 1_000_000)) if any(p.endswith(".gz") for p in paths) else table


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """chr and pos of a site file; blank and comment lines are skipped."""
    parts = F.split("value", "\t")
    return _lines(spark, path).select(F.get(parts, F.lit(0)).alias("chr"), F.get(parts, F.lit(1)).try_cast("bigint").alias("pos"))


def read_regions(spark: SparkSession, path: str, kind: str | None = None, parser: Callable[[Column], Column] | None = None) -> DataFrame:
    """ord, chr, beg, end as 0-based half-open intervals from bed, tab, vcf or reg lines.

    Tab and VCF positions are 1-based; a line with a name alone is the whole sequence.  ``parser``
    reads lines of any other make: from the line's column it makes a struct with chr, beg, end
    and whatever else goes with a region; lines of which it makes null are left out.
    """
    if parser is not None:
        parsed = _lines(spark, path).select("ord", parser(F.col("value")).alias("_r")).where(F.col("_r").isNotNull())
        return parsed.select("ord", "_r.*")
    kind = kind or detect_region_format(path)
    whole = F.lit((1 << 63) - 1)
    if kind == "reg":
        m = lambda g: F.regexp_extract("value", r"^([^:]+)(?::(\d+)(?:-(\d+))?)?", g)
        beg, end = m(2).try_cast("bigint"), m(3).try_cast("bigint")
        return _lines(spark, path).select("ord", m(1).alias("chr"), F.coalesce(beg - 1, F.lit(0)).alias("beg"), F.when(beg.isNull(), whole).otherwise(F.coalesce(end, beg)).alias("end"))
    parts = F.split(F.trim("value"), r"\s+")
    at = lambda i: F.get(parts, F.lit(i))
    rows = _lines(spark, path).where(~F.col("value").rlike(r"^(track|browser)\s"))
    b, e = at(1).try_cast("bigint"), at(2).try_cast("bigint")
    if kind == "bed":
        return rows.select("ord", at(0).alias("chr"), F.coalesce(b, F.lit(0)).alias("beg"), F.coalesce(e, whole).alias("end"))
    if kind == "vcf":
        return rows.select("ord", at(0).alias("chr"), (b - 1).alias("beg"), (b - 1 + F.coalesce(F.length(at(3)), F.lit(1))).alias("end"))
    return rows.select("ord", at(0).alias("chr"), F.coalesce(b - 1, F.lit(0)).alias("beg"), F.when(b.isNull(), whole).otherwise(F.coalesce(e, b)).alias("end"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return read_regions(spark, _suffixed(path, ".bed", ".bed.gz"), "bed")


def read_list(spark: SparkSession, text: str) -> DataFrame:
    """Names from a comma list, or one a line from a file given as @path."""
    if text.startswith("@"):
        return spark.read.text(text[1:]).select(F.trim("value").alias("name")).where("name <> ''")
    return spark.range(1).select(F.explode(F.split(F.lit(text), ",")).alias("name"))


def _write(df: DataFrame, path: str, header: bool = False) -> None:
    df.write.csv(path, sep="\t", header=header, quote="", escape="", emptyValue="", mode="errorifexists", compression="gzip" if path.rstrip("/").endswith(".gz") else "none")


def ordered_by(table: DataFrame, names: list[str]) -> Column:
    """A column that ranks ``chr`` as a header lists the sequences; unlisted ones come last."""
    listed = F.array(*map(F.lit, names)).cast("array<string>")
    return F.coalesce(F.nullif(F.array_position(listed, F.col("chr")), F.lit(0)), F.lit(len(names) + 1))


def write_haplotypes(table: DataFrame, path: str, names: list[str] | None = None) -> None:
    """Ordered haplotype lines, in as many files as there are ranges; chromosomes in the order of
    ``names``, a file's header, if it is given."""
    keys = ["chr", "beg", "end", "hap", "cnt", "strand"] if names is None else [ordered_by(table, names), "chr", "beg", "end", "hap", "strand"]
    _write(table.select("chr", "beg", "end", "hap", "cnt", "strand").orderBy(*keys), _suffixed(path, ".mhap.gz", ".mhap"))


def write_beta(table: DataFrame, path: str) -> None:
    """Sites in the order of chromosome, position and strand; no header."""
    start = "pos" if "pos" in table.columns else "beg"
    keys = ["chr", "pos", "strand"] if start == "pos" else [F.concat_ws("\t", "chr", "beg", "end"), "strand"]
    _write(table.orderBy(*keys).select("chr", start, "end", "pct", "meth", "unmeth", "strand"), path)


def write_summary(table: DataFrame, path: str) -> None:
    """The eleven columns with a header; regions keep the order of their list.  Without rows
    there is no header either."""
    spark = table.sparkSession
    start = "pos" if "pos" in table.columns else "beg"
    if start == "beg":
        first = table.groupBy(F.col("chr").alias("_c")).agg(F.min("ord").alias("_first"))
        table = table.join(F.broadcast(first), F.col("chr") == F.col("_c")).orderBy("_first", "ord", "strand")
    else:
        table = table.orderBy("chr", "pos", "strand")
    columns = ["chr", start, "end", "strand", *SUMMARY_COLUMNS[4:]]
    named = table.select(*[F.col(c).alias(n) for c, n in zip(columns, SUMMARY_COLUMNS)])
    _write(named, path, header=True)
    if spark.read.text(path).where(~F.col("value").startswith(SUMMARY_COLUMNS[0] + "\t")).isEmpty():
        spark.createDataFrame([], named.schema).coalesce(1).write.csv(path, sep="\t", header=False, mode="overwrite")


def store_clustered(table: DataFrame, path: str, start: str = "beg") -> None:
    """Keep a table as Parquet in the order of chr and start, dealt by ranges, so that the
    statistics of files and row groups stand in for an index."""
    table.repartitionByRange("chr", start).sortWithinPartitions("chr", start).write.option("parquet.block.size", 16 << 20).parquet(path)


def scan_range(spark: SparkSession, path: str, chr: str, beg: int, end: int, start: str = "beg", stop: str = "end") -> DataFrame:
    """The rows of a clustered table whose [start, stop] meets [beg, end]; the three conditions
    reach the Parquet scan, which reads the row groups that may hold such rows."""
    return spark.read.parquet(path).where((F.col("chr") == chr) & (F.col(start) <= end) & (F.col(stop) >= beg))
