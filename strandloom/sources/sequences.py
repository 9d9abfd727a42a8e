"""FASTA and FASTQ as chunk tables, and region fetch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lines import numbered_lines

#: Lines of a file that stand in one window.
STRETCH = 1 << 16


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """name, offset and seq of every line of one file or many.

    A line belongs to the last header before it in its file, which is found by running maxima
    within stretches of lines and over the stretches' own maxima; offsets likewise by sums.
    """
    lines = numbered_lines(spark, path).where("value <> ''").withColumn("k", F.floor(F.col("n") / STRETCH))
    header = F.col("value").startswith(">")
    inner = lines.withColumn("h", F.max(F.when(header, F.col("n"))).over(Window.partitionBy("file", "k").orderBy("n")))
    tops = inner.groupBy("file", "k").agg(F.max("h").alias("top"))
    earlier = Window.partitionBy("file").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(F.col("file").alias("_file"), F.col("k").alias("_k"), F.max("top").over(earlier).alias("before"))
    owned = inner.join(carried, (F.col("file") == F.col("_file")) & (F.col("k") == F.col("_k"))).select("file", "k", "n", "value", F.coalesce("h", "before").alias("h"))
    names = lines.where(header).select(F.col("file").alias("_file"), F.col("n").alias("_n"), F.regexp_extract("value", r"^>(\S*)", 1).alias("name"))
    body = owned.where(~header).select("file", "k", "h", "n", F.upper(F.trim("value")).alias("seq"))
    within = Window.partitionBy("file", "h", "k").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("file", "h").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    sums = body.groupBy("file", "h", "k").agg(F.sum(F.length("seq")).alias("size"))
    bases = sums.select(F.col("file").alias("_b_file"), F.col("h").alias("_b_h"), F.col("k").alias("_b_k"), F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("base"))
    placed = body.withColumn("offset", F.coalesce(F.sum(F.length("seq")).over(within), F.lit(0)))
    placed = placed.join(bases, (F.col("file") == F.col("_b_file")) & (F.col("h") == F.col("_b_h")) & (F.col("k") == F.col("_b_k")))
    met = placed.join(names, (F.col("file") == F.col("_file")) & (F.col("h") == F.col("_n")))
    return met.select("name", (F.col("offset") + F.col("base")).alias("offset"), "seq")


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, ord (the record's number in its file), name, seq and qual of four-line records.

    A record that is cut short, does not begin with @ and + or has qualities of another length
    than its bases is an error; blank lines at the end are ignored.
    """
    lines = numbered_lines(spark, path)
    line = lambda k: F.max(F.when(F.col("n") % 4 == k, F.col("value"))).alias(f"l{k}")
    grouped = lines.groupBy("file", F.floor(F.col("n") / 4).alias("ord")).agg(*[line(k) for k in range(4)])
    some = grouped.where("coalesce(l0, '') <> '' OR coalesce(l1, '') <> '' OR coalesce(l2, '') <> '' OR coalesce(l3, '') <> ''")
    whole = F.col("l0").startswith("@") & F.col("l2").startswith("+") & (F.length("l1") == F.length("l3"))
    name = F.when(F.coalesce(whole, F.lit(False)), F.regexp_extract("l0", r"^@(\S*)", 1)).otherwise(F.raise_error(F.concat(F.lit("not a FASTQ record: "), F.coalesce("l0", F.lit("")))))
    return some.select("file", "ord", name.alias("name"), F.col("l1").alias("seq"), F.col("l3").alias("qual"))


def lengths(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("name").agg(F.sum(F.length("seq")).cast("long").alias("length"))


def fetch(chunks: DataFrame, regions: DataFrame) -> DataFrame:
    """The bases of each region (ord, chr, beg, end; 0-based, half-open), cut at the end."""
    end = F.col("offset") + F.length("seq")
    met = regions.join(chunks, (F.col("chr") == F.col("name")) & (F.col("offset") < F.col("end")) & (end > F.col("beg")))
    lo = F.greatest(F.col("beg") - F.col("offset"), F.lit(0))
    hi = F.least(F.col("end") - F.col("offset"), F.length("seq").cast("long"))
    cut = met.select("ord", "chr", "beg", "end", "offset", F.substr(F.col("seq"), (lo + 1).cast("int"), (hi - lo).cast("int")).alias("part"))
    return cut.groupBy("ord", "chr", "beg", "end").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "part"))), lambda x: x["part"]), "").alias("seq"))
