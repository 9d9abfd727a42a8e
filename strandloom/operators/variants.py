"""Variant records: types, genotype classes and allele counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed codes of variant types and genotype classes.
REF, SNP, MNP, INDEL, OTHER, BND, OVERLAP = 0, 1, 2, 4, 8, 16, 32
HOM_RR, HOM_AA, HET_RA, HET_AA, HAPL_R, HAPL_A, UNKNOWN = 0, 1, 2, 3, 4, 5, 6


def variant_type(ref: Column, alt: Column) -> Column:
    """struct<type, n> of an alternate allele: the kind and the signed length.

    Alleles are compared without regard to case after their common start and end are cut
    off (the end only while both keep a base).
    """
    r, a = F.upper(ref), F.upper(alt)
    shorter = F.least(F.length(r), F.length(a))
    start = F.size(F.filter(F.sequence(F.lit(1), shorter), lambda i: F.substr(r, F.lit(1), i) == F.substr(a, F.lit(1), i)))
    lr, la = F.length(r) - start, F.length(a) - start
    keep = F.greatest(F.least(lr, la) - 1, F.lit(0))
    tail = F.when(keep == 0, 0).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.greatest(keep, F.lit(1))), lambda i: F.right(r, i) == F.right(a, i))))
    lr2, la2 = lr - tail, la - tail
    last_same = F.substr(r, F.length(r) - tail, F.lit(1)) == F.substr(a, F.length(a) - tail, F.lit(1))
    kind = lambda t, n: F.struct(F.lit(t).alias("type"), n.cast("int").alias("n"))
    zero, one = F.lit(0), F.lit(1)
    one_left = lambda n: F.when(last_same, kind(INDEL, n)).otherwise(kind(OTHER, n))
    single = (F.length(ref) == 1) & (F.length(alt) == 1)
    return (
        F.when(alt == "*", kind(OVERLAP, zero))
        .when(single & ((alt == ".") | (alt == ref) | (alt == "X")), kind(REF, zero))
        .when(single, kind(SNP, one))
        .when(alt.startswith("<X>") | alt.startswith("<*>"), kind(REF, zero))
        .when(alt.startswith("<"), kind(OTHER, zero))
        .when((lr == 0) & (la == 0), kind(REF, zero))
        .when((lr == 0) & F.substr(a, start + 1, F.lit(1)).isin("]", "["), kind(BND, zero))
        .when((lr == 0) | (la == 0), kind(INDEL, la - lr))
        .when((lr2 == 1) & (la2 == 1), kind(SNP, one))
        .when(la2 == 1, one_left(1 - lr2))
        .when(lr2 == 1, one_left(la2 - 1))
        .when(lr2 == la2, kind(MNP, la2))
        .otherwise(kind(OTHER, F.when(lr2 > la2, -lr2).otherwise(la2)))
    )


def record_type(ref: Column, alts: Column) -> Column:
    """The union of the types of all alternate alleles."""
    return F.aggregate(F.transform(alts, lambda a: variant_type(ref, a)["type"]), F.lit(0), lambda x, y: x.bitwiseOR(y))


def is_snp(ref: Column, alts: Column) -> Column:
    """All alleles of length one and none '*', symbolic <X> and <*> aside."""
    ok = lambda x: ((F.length(x) == 1) & (x != "*")) | x.isin("<X>", "<*>")
    return ok(ref) & F.forall(alts, ok)


def has_filter(filters: Column, name: Column) -> Column:
    """Whether a record has a filter; '.' and PASS mean an empty or PASS list."""
    passing = (F.size(filters) == 0) | F.array_contains(filters, "PASS")
    return F.when(name.isin(".", "PASS"), passing).otherwise(F.array_contains(filters, name))


def genotype_class(alleles: Column) -> Column:
    """Class of a genotype given as allele numbers (0 reference; a null is missing)."""
    alt = F.array_distinct(F.filter(alleles, lambda x: x > 0))
    reference = F.exists(alleles, lambda x: x == 0)
    return (
        F.when((F.size(alleles) <= 0) | F.exists(alleles, lambda x: x.isNull()), UNKNOWN)
        .when(F.size(alleles) == 1, F.when(reference, HAPL_R).otherwise(HAPL_A))
        .when(~reference, F.when(F.size(alt) == 1, HOM_AA).otherwise(HET_AA))
        .when(F.size(alt) == 0, HOM_RR)
        .otherwise(HET_RA)
    )


def parse_genotype(gt: Column) -> Column:
    """Allele numbers of GT text such as 0/1 or .|2."""
    return F.transform(F.split(gt, "[/|]"), lambda x: x.try_cast("int"))


def allele_counts(genotypes: DataFrame) -> DataFrame:
    """Calls of each allele by variant (columns variant, alleles)."""
    each = genotypes.select("variant", F.explode("alleles").alias("allele")).where(F.col("allele").isNotNull())
    return each.groupBy("variant", "allele").agg(F.count("*").alias("n"))


def keep_alleles(ref: Column, alts: Column, keep: Column) -> Column:
    """Alternate alleles at the kept (1-based) numbers."""
    return F.filter(alts, lambda a, i: F.array_contains(keep, i + 1))


def remap_numbers(values: Column, number: str, keep: Column) -> Column:
    """Values of a field with Number=A, R or G after only the kept (1-based) alternates stay.

    Genotype order is by the second allele, then the first: pair (j, k), j <= k, stands at
    k (k + 1) / 2 + j.
    """
    if number == "A":
        return F.filter(values, lambda _, i: F.array_contains(keep, i + 1))
    stays = F.concat(F.array(F.lit(0)), keep)
    if number == "R":
        return F.filter(values, lambda _, i: F.array_contains(stays, i))
    if number == "G":
        pairs = F.flatten(F.transform(stays, lambda k: F.transform(F.filter(stays, lambda j: j <= k), lambda j: (F.floor(k * (k + 1) / 2) + j).cast("int"))))
        return F.transform(pairs, lambda at: F.get(values, at))
    return values


def targets(table: DataFrame, regions: DataFrame, exclude: bool = False) -> DataFrame:
    """Records (chr, pos) that lie in any region (closed), or in none."""
    from .interval_join import point_in_interval

    places = table.select(F.col("chr").alias("_p_chr"), F.col("pos").alias("_p_pos")).distinct()
    wanted = regions.select(F.col("chr").alias("_t_chr"), F.col("beg").alias("_t_beg"), F.col("end").alias("_t_end"))
    hit = point_in_interval(wanted, places, "_t_chr", F.col("_t_beg"), F.col("_t_end"), "_p_chr", "_p_pos").select("_p_chr", "_p_pos").distinct()
    return table.join(hit, (F.col("chr") == F.col("_p_chr")) & (F.col("pos") == F.col("_p_pos")), "left_anti" if exclude else "left_semi")


def add_filter(filters: Column, name: str) -> Column:
    """Add a filter: PASS gives way to another, duplicates are ignored."""
    if name == "PASS":
        return F.array(F.lit("PASS"))
    return F.array_union(F.array_remove(filters, "PASS"), F.array(F.lit(name)))


def remove_filter(filters: Column, name: str, to_pass: bool = True) -> Column:
    """Remove a filter; an emptied list becomes PASS if wanted."""
    rest = F.array_remove(filters, name)
    return F.when((F.size(rest) == 0) & F.lit(to_pass), F.array(F.lit("PASS"))).otherwise(rest)


def set_info(info: Column, key: str, value: Column | None) -> Column:
    """An INFO map with a key set to text (an empty one for a flag), or without it if None."""
    rest = F.map_filter(info, lambda k, _: k != key)
    return rest if value is None else F.map_concat(rest, F.create_map(F.lit(key), value.cast("string")))


def set_format(samples: Column, key: str, values: Column | None) -> Column:
    """A sample map with a field set from a map of sample to text ('.' where it has none), or
    without the field if None."""

    def one(name, fields):
        rest = F.map_filter(fields, lambda k, _: k != key)
        return rest if values is None else F.map_concat(rest, F.create_map(F.lit(key), F.coalesce(F.element_at(values, name), F.lit("."))))

    return F.transform_values(samples, one)


def set_id(old: Column, name: Column) -> Column:
    """The id replaced; '.' and the empty text mean none."""
    return F.nullif(F.nullif(name, F.lit(".")), F.lit(""))


def add_id(old: Column, name: Column) -> Column:
    """The ids (joined by ;) with another, which is ignored if it is there or is '.'."""
    known = F.array_contains(F.split(old, ";"), name)
    return F.when(name.isNull() | (name == "."), old).when(old.isNull() | (old == "."), name).when(known, old).otherwise(F.concat_ws(";", old, name))


def set_alleles(table: DataFrame, ref: Column, alts: Column) -> DataFrame:
    """Records with new alleles; the span of the reference allele changes with it."""
    return table.withColumns({"ref": ref, "alts": alts})


def synchronized(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer merge of two variant tables (chr, pos, ref, alt) on place and type.

    At each position rows with equal alleles meet first, repeated ones in turn, then rows whose
    alleles differ in case only; of what is left, rows of one type meet in the order of their
    alleles.  Other rows, and those without a place, stay alone.
    """
    from pyspark.sql import Window

    sides = [df.select("chr", "pos", "ref", "alt", F.lit(side).alias("_right")) for df, side in ((left, False), (right, True))]
    # all that follows is within a position: one shuffle
    rows = sides[0].unionByName(sides[1]).repartition("chr", "pos").withColumn("_round", F.lit(None).cast("int"))
    kind = variant_type(F.col("ref"), F.col("alt"))["type"]
    keys = [F.array("ref", "alt"), F.array(F.upper("ref"), F.upper("alt")), F.array(kind.cast("string"))]
    group = ["chr", "pos", "_round", "_key", "_n"]
    for at, key in enumerate(keys):
        rows = rows.withColumn("_key", F.when(F.col("_round").isNull(), key).otherwise(F.col("_key")) if at else key)
        turn = F.row_number().over(Window.partitionBy("chr", "pos", "_round", "_key", "_right").orderBy("ref", "alt"))
        rows = rows.withColumn("_n", F.when(F.col("_round").isNull(), turn).otherwise(F.col("_n")) if at else turn)
        pair = Window.partitionBy(*group)
        meets = F.col("_round").isNull() & F.col("chr").isNotNull() & F.col("pos").isNotNull() & (F.min("_right").over(pair) != F.max("_right").over(pair))
        if at == len(keys) - 1:
            meets &= kind.isNotNull()
        rows = rows.withColumn("_round", F.when(meets, at).otherwise(F.col("_round")))
    alone = F.when(F.col("_round").isNull(), F.col("_right"))
    one = lambda c, side: F.max(F.when(F.col("_right") == side, F.col(c)))
    met = rows.groupBy(*group, alone.alias("_alone")).agg(one("ref", False).alias("l_ref"), one("alt", False).alias("l_alt"), one("ref", True).alias("r_ref"), one("alt", True).alias("r_alt"))
    return met.select("chr", "pos", "l_ref", "l_alt", "r_ref", "r_alt")
