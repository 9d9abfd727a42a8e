"""SAM text: records, headers and a writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ["qname", "flag", "chr", "pos", "mapq", "cigar", "mchr", "mpos", "tlen", "seq", "qual"]


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Records as the alignment schema: pos and mpos 0-based, optional fields as a map from
    tag to TYPE:VALUE, ``ord`` in file order, and xm with its type for the bisulfite check."""
    lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()).where(~F.col("value").startswith("@") & (F.col("value") != ""))
    parts = F.split("value", "\t")
    at = lambda i: F.get(parts, F.lit(i))
    tags = F.filter(F.slice(parts, 12, 1 << 30), lambda t: F.length(t) >= 5)
    aux = F.map_from_entries(F.transform(tags, lambda t: F.struct(F.substr(t, F.lit(1), F.lit(2)), F.substr(t, F.lit(4)))))
    rows = lines.select(
        "ord", at(0).alias("qname"), at(1).try_cast("int").alias("flag"), at(2).alias("chr"), (at(3).try_cast("bigint") - 1).alias("pos"), at(4).try_cast("int").alias("mapq"), at(5).alias("cigar"),
        F.when(at(6) == "=", at(2)).otherwise(at(6)).alias("mchr"), (at(7).try_cast("bigint") - 1).alias("mpos"), at(8).try_cast("bigint").alias("tlen"), at(9).alias("seq"), at(10).alias("qual"), aux.alias("aux"),
    )
    return rows.withColumns({"xm": F.substr(F.element_at("aux", "XM"), F.lit(3)), "xm_type": F.substr(F.element_at("aux", "XM"), F.lit(1), F.lit(1))})


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """Header lines as (line, type, tags); @CO text stands under the tag ''."""
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).where(F.col("value").startswith("@"))
    return parse_header(lines)


def parse_header(lines: DataFrame) -> DataFrame:
    parts = F.split("value", "\t")
    kind = F.substr(F.get(parts, F.lit(0)), F.lit(2))
    fields = F.map_from_entries(F.transform(F.slice(parts, 2, 1 << 30), lambda t: F.struct(F.substr(t, F.lit(1), F.lit(2)), F.substr(t, F.lit(4)))))
    text = F.create_map(F.lit(""), F.substring_index("value", "\t", -1))
    return lines.select("line", kind.alias("type"), F.when(kind == "CO", text).otherwise(fields).alias("tags"))


def update_header(header: DataFrame, kind: str, key: str, value: str, tags: dict[str, str]) -> DataFrame:
    """Set tags of the lines of a type whose ``key`` is ``value``."""
    new = F.create_map(*[F.lit(x) for kv in tags.items() for x in kv])
    hit = (F.col("type") == kind) & (F.element_at("tags", key) == value)
    kept = F.map_filter("tags", lambda k, _: ~k.isin(*tags))
    return header.withColumn("tags", F.when(hit, F.map_concat(kept, new)).otherwise(F.col("tags")))


def remove_header_lines(header: DataFrame, kind: str, key: str | None = None, value: str | None = None) -> DataFrame:
    hit = F.col("type") == kind
    if key is not None:
        hit = hit & (F.element_at("tags", key) == value)
    return header.where(~F.coalesce(hit, F.lit(False)))


def count_header_lines(header: DataFrame, kind: str) -> int:
    return header.where(F.col("type") == kind).count()


def find_header_lines(header: DataFrame, kind: str, key: str | None = None, value: str | None = None) -> DataFrame:
    """The lines of a type, or of these the ones whose ``key`` is ``value``, in order."""
    hit = F.col("type") == kind
    if key is not None:
        hit = hit & (F.element_at("tags", key) == value)
    return header.where(hit).orderBy("line")


def header_tag(header: DataFrame, kind: str, key: str, value: str, tag: str) -> str | None:
    """A tag of the first line of a type whose ``key`` is ``value``; None without one."""
    row = find_header_lines(header, kind, key, value).select(F.element_at("tags", tag).alias("t")).first()
    return row["t"] if row else None


def remove_header_tag(header: DataFrame, kind: str, key: str, value: str, tag: str) -> DataFrame:
    """Lines of a type whose ``key`` is ``value`` without a tag."""
    hit = (F.col("type") == kind) & (F.element_at("tags", key) == value)
    return header.withColumn("tags", F.when(hit, F.map_filter("tags", lambda k, _: k != tag)).otherwise(F.col("tags")))


def rename_header_line(header: DataFrame, kind: str, key: str, old: str, new: str) -> DataFrame:
    """A line's identity changed, and in @PG lines the programs that follow it; an identity that
    another line has already is an error."""
    if find_header_lines(header, kind, key, new).limit(1).count():
        raise ValueError(f"there is a @{kind} line with {key}:{new} already")

    def swap(tag, hit):
        return F.transform_values("tags", lambda k, v: F.when(hit & (k == tag) & (v == old), new).otherwise(v))

    out = header.withColumn("tags", swap(key, F.col("type") == kind))
    return out.withColumn("tags", swap("PP", F.col("type") == "PG")) if kind == "PG" and key == "ID" else out


def set_query_name(records: DataFrame, name: Column) -> DataFrame:
    """Records with new names; one that is empty, longer than 254 bytes or has a blank is an
    error, as the formats have no place for it."""
    ok = (F.octet_length(name) >= 1) & (F.octet_length(name) <= 254) & ~name.rlike(r"\s")
    return records.withColumn("qname", F.when(F.coalesce(ok, F.lit(False)), name).otherwise(F.raise_error(F.concat(F.lit("not a query name: "), F.coalesce(name, F.lit("null"))))))


def add_header_line(header: DataFrame, kind: str, tags: dict[str, str]) -> DataFrame:
    """Append a line; a @PG line is chained to the last program that no other follows."""
    spark = header.sparkSession
    if kind == "PG" and "PP" not in tags:
        programs = header.where("type = 'PG'").select("line", F.element_at("tags", "ID").alias("id"), F.element_at("tags", "PP").alias("pp"))
        ends = programs.join(programs.select(F.col("pp").alias("_pp")), F.col("id") == F.col("_pp"), "left_anti").orderBy(F.desc("line")).first()
        if ends:
            tags = {**tags, "PP": ends["id"]}
    last = header.agg(F.max("line")).first()[0]
    row = spark.createDataFrame([((last if last is not None else -1) + 1, kind, tags)], header.schema)
    return header.unionByName(row)


def merge_headers(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The lines of all headers: of lines with one identity (SN, ID, or the whole of the
    others) the first file's stays."""
    from functools import reduce

    from pyspark.sql import Window

    every = reduce(DataFrame.unionByName, [h.withColumn("_file", F.lit(i)) for i, h in enumerate((first, *others))])
    name = F.coalesce(F.element_at("tags", "SN"), F.element_at("tags", "ID"), F.when(F.col("type") == "HD", "").otherwise(F.to_json("tags")))
    order = Window.partitionBy("type", "_name").orderBy("_file", "line")
    kept = every.withColumn("_name", name).withColumn("_rn", F.row_number().over(order)).where("_rn = 1")
    rank = F.when(F.col("type") == "HD", 0).when(F.col("type") == "SQ", 1).when(F.col("type") == "RG", 2).when(F.col("type") == "PG", 3).otherwise(4).cast("long")
    return kept.select((rank * (1 << 40) + F.col("_file") * (1 << 32) + F.col("line")).alias("line"), "type", "tags")


def header_lines(header: DataFrame) -> DataFrame:
    """Header text lines in order."""
    fields = F.transform(F.map_entries("tags"), lambda e: F.when(e["key"] == "", e["value"]).otherwise(F.concat(e["key"], F.lit(":"), e["value"])))
    return header.orderBy("line").select(F.concat_ws("\t", F.concat(F.lit("@"), "type"), F.array_join(fields, "\t")).alias("value"))


def sam_lines(records: DataFrame) -> DataFrame:
    """Record text lines in order."""
    mate = F.when((F.col("mchr") == F.col("chr")) & (F.col("chr") != "*"), "=").otherwise(F.col("mchr"))
    tags = F.transform(F.map_entries("aux"), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    fixed = [F.col(c).cast("string") for c in ("qname", "flag", "chr")] + [(F.col("pos") + 1).cast("string"), F.col("mapq").cast("string"), F.col("cigar"), mate, (F.col("mpos") + 1).cast("string"), F.col("tlen").cast("string"), F.col("seq"), F.col("qual")]
    body = F.concat_ws("\t", *fixed)
    return records.orderBy("ord").select(F.when(F.size("aux") > 0, F.concat_ws("\t", body, F.array_join(tags, "\t"))).otherwise(body).alias("value"))


def write_sam(records: DataFrame, path: str) -> None:
    sam_lines(records).write.text(path)
