"""VCF text with typed INFO, and a writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import numbered_lines

_TYPES = {"Integer": "int", "Float": "double", "String": "string", "Character": "string", "Flag": "boolean"}


def read_vcf_header(spark: SparkSession, path: str) -> DataFrame:
    """kind (INFO, FORMAT, FILTER, contig, ...), id, number and type of the header's entries."""
    lines = spark.read.text(path).where(F.col("value").startswith("##") & F.col("value").contains("=<"))
    part = lambda name: F.nullif(F.regexp_extract("value", rf"[<,]{name}=([^,>]*)", 1), F.lit(""))
    return lines.select(F.regexp_extract("value", r"^##([^=]+)=<", 1).alias("kind"), part("ID").alias("id"), part("Number").alias("number"), part("Type").alias("type"))


def header_table(lines: DataFrame) -> DataFrame:
    """line, kind, id, number, type and value of header lines (line, value); ``id`` is null for
    generic ones (##key=text)."""
    part = lambda name: F.nullif(F.regexp_extract("value", rf"[<,]{name}=([^,>]*)", 1), F.lit(""))
    structured = F.col("value").rlike("^##[^=]+=<")
    own = lambda name: F.when(structured, part(name))
    return lines.where(F.col("value").startswith("##")).select("line", F.regexp_extract("value", r"^##([^=]+)=", 1).alias("kind"), own("ID").alias("id"), own("Number").alias("number"), own("Type").alias("type"), "value")


def merge_headers(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The lines of all header tables.  Of entries with one kind and id, and of generic lines with
    one key, the first file's stay; generic lines that one file repeats stay as they are.
    ``conflict`` marks entries that another file defines with another number or type."""
    from functools import reduce

    from pyspark.sql import Window

    every = reduce(DataFrame.unionByName, [h.withColumn("_file", F.lit(i)) for i, h in enumerate((first, *others))])
    known = Window.partitionBy("kind", "id")
    marked = every.withColumns({
        "_first": F.min("_file").over(known),
        "conflict": F.col("kind").isin("INFO", "FORMAT") & (F.size(F.collect_set(F.concat_ws("|", F.coalesce("number", F.lit("")), F.coalesce("type", F.lit("")))).over(known)) > 1),
        "_rn": F.row_number().over(known.orderBy("_file", "line")),
    })
    kept = marked.where((F.col("_file") == F.col("_first")) & (F.col("id").isNull() | (F.col("_rn") == 1)))
    return kept.select((F.col("_file") * (1 << 32) + F.col("line")).alias("line"), "kind", "id", "number", "type", "value", F.coalesce("conflict", F.lit(False)).alias("conflict"))


def sample_names(spark: SparkSession, path: str) -> list[str]:
    row = spark.read.text(path).where(F.col("value").startswith("#CHROM")).first()
    return row["value"].split("\t")[9:] if row else []


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """chr, pos (1-based), id, ref, alts, qual, filters, info and, by sample, a map of fields."""
    names = sample_names(spark, path)
    parts = F.split("value", "\t")
    at = lambda i: F.get(parts, F.lit(i))
    missing = lambda c: F.nullif(c, F.lit("."))
    listed = lambda c, sep: F.when(c == ".", F.array().cast("array<string>")).otherwise(F.split(c, sep))
    info = F.map_from_entries(F.transform(listed(at(7), ";"), lambda e: F.struct(F.substring_index(e, "=", 1), F.when(e.contains("="), F.substr(e, F.locate("=", e) + 1)).otherwise(F.lit("")))))
    keys = F.split(at(8), ":")

    def fields(i):
        values = F.split(at(9 + i), ":")
        # trailing fields may be left out
        return F.map_from_arrays(keys, F.transform(keys, lambda _, k: F.coalesce(F.get(values, k), F.lit("."))))

    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    samples = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[fields(i) for i in range(len(names))])) if names else F.lit(None).cast("map<string,map<string,string>>")
    return rows.select(at(0).alias("chr"), at(1).cast("long").alias("pos"), missing(at(2)).alias("id"), at(3).alias("ref"), listed(at(4), ",").alias("alts"), at(5).try_cast("double").alias("qual"), listed(at(6), ";").alias("filters"), info.alias("info"), samples.alias("samples"))


def typed_info(info: Column, key: str, kind: str, number: str) -> Column:
    """An INFO value by its header type: Flag as boolean, number 1 as a scalar, else an array."""
    value = F.element_at(info, key)
    if kind == "Flag":
        return F.coalesce(F.array_contains(F.map_keys(info), key), F.lit(False))
    if number == "1":
        return value.try_cast(_TYPES[kind])
    return F.transform(F.split(value, ","), lambda x: x.try_cast(_TYPES[kind]))


def record_span(pos: Column, ref: Column, info: Column) -> tuple[Column, Column]:
    """0-based half-open interval: the reference allele's, or up to END."""
    end = F.coalesce(F.element_at(info, "END").try_cast("bigint"), pos - 1 + F.length(ref))
    return pos - 1, end


def keep_samples(samples: Column, names: list[str]) -> Column:
    return F.map_filter(samples, lambda k, _: k.isin(*names))


def vcf_lines(records: DataFrame, names: list[str]) -> DataFrame:
    """Text lines in the order of chromosome and position."""
    joined = lambda c, sep: F.when(F.size(c) > 0, F.array_join(c, sep)).otherwise(".")
    info = F.transform(F.map_entries("info"), lambda e: F.when(e["value"] == "", e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"])))
    cells = [F.col("chr"), F.col("pos").cast("string"), F.coalesce("id", F.lit(".")), F.col("ref"), joined("alts", ","), F.coalesce(F.regexp_replace(F.col("qual").cast("string"), r"\.0$", ""), F.lit(".")), joined("filters", ";"), joined(info, ";")]
    if names:
        first = F.element_at("samples", names[0])
        cells.append(F.array_join(F.map_keys(first), ":"))
        cells += [F.array_join(F.map_values(F.element_at("samples", n)), ":") for n in names]
    return records.orderBy("chr", "pos").select(F.concat_ws("\t", *cells).alias("value"))


def write_vcf(records: DataFrame, header: list[str], names: list[str], path: str) -> None:
    """Header lines, then the records in order, as a folder of text parts that make one file."""
    spark = records.sparkSession
    top = spark.createDataFrame([(x,) for x in header], "value string").coalesce(1)
    top.unionByName(vcf_lines(records, names)).write.text(path)


def reheader(spark: SparkSession, path: str, header: list[str], out: str) -> None:
    """A text table with other header lines: those of ``path`` that begin with # go, all else
    stays line by line and in order."""
    body = numbered_lines(spark, path).where(~F.col("value").startswith("#")).orderBy("file", "n").select("value")
    spark.createDataFrame([(x,) for x in header], "value string").coalesce(1).unionByName(body).write.text(out)
