"""Column expressions over alignments: flags, strand, bases, CIGAR and tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import EXCLUDED, FLAG_NAMES, MATE_REVERSE, PAIRED, PROPER, READ1, READ2, REVERSE


def has(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(F.lit(bit)) != 0


def usable(flag: Column, seq: Column) -> Column:
    """Primary, mapped, not a duplicate, passing, and with bases."""
    return (flag.bitwiseAND(F.lit(EXCLUDED)) == 0) & (F.length(seq) > 0) & (seq != "*")


def passes_bisulfite_qc(xm: Column, xm_type: Column | None = None) -> Column:
    """No XM tag, or a text one without methylation calls outside CpG (X, H, U)."""
    clean = ~xm.rlike("[XHU]")
    if xm_type is not None:
        clean = clean & xm_type.isin("Z", "H")
    return xm.isNull() | clean


def strand_code(flag: Column, directional: bool = True) -> Column:
    """0 unknown, 1 plus, 2 minus; null where exactly one of paired and proper is set."""
    if not directional:
        return F.lit(0)
    paired, proper = has(flag, PAIRED), has(flag, PROPER)
    reverse, mate_reverse = has(flag, REVERSE), has(flag, MATE_REVERSE)
    first = F.when(reverse, 2).when(mate_reverse, 1).otherwise(0)
    second = F.when(reverse, 1).when(mate_reverse, 2).otherwise(0)
    pair = F.when(has(flag, READ1), first).when(has(flag, READ2), second).otherwise(0)
    return F.when(paired & proper, pair).when(~paired & ~proper, F.when(reverse, 2).otherwise(1))


def strand_symbol(code: Column) -> Column:
    return F.when(code == 1, "+").when(code == 2, "-").otherwise("*")


def methylation(base: Column, code: Column, mode: str = "BS") -> Column:
    """'1' or '0' for a legal base at a site, null otherwise."""
    if mode not in ("BS", "TAPS"):
        raise ValueError(f"mode must be BS or TAPS, not {mode!r}")
    kept, turned = ("1", "0") if mode == "BS" else ("0", "1")
    plus = F.when(base == "C", kept).when(base == "T", turned)
    minus = F.when(base == "G", kept).when(base == "A", turned)
    return F.when(code == 2, minus).otherwise(plus)


def quality_at(qual: Column, offset: Column) -> Column:
    """Signed 8-bit base quality from Phred+33 text; missing qualities are -1."""
    q = F.ascii(F.substr(qual, offset + 1, F.lit(1))) - 33
    return F.when(qual == "*", -1).when(q > 127, q - 256).otherwise(q)


def cigar_parts(cigar: Column) -> Column:
    """array<struct<len, op>> of CIGAR text; empty for '*'."""
    return F.transform(
        F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=XB])"), F.lit(1)),
        lambda x: F.struct(F.regexp_extract(x, r"\d+", 0).cast("long").alias("len"), F.substr(x, F.length(x), F.lit(1)).alias("op")),
    )


def cigar_runs(cigar: Column) -> Column:
    """array<struct<op, len, r, q>>: every run with its first reference and query offsets."""
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("r"), zero.alias("q"), F.expr("cast(array() as array<struct<op:string,len:bigint,r:bigint,q:bigint>>)").alias("out"))
    step = lambda a, p: F.struct(
        (a["r"] + F.when(F.lit("MDN=X").contains(p["op"]), p["len"]).otherwise(0)).alias("r"),
        (a["q"] + F.when(F.lit("MIS=X").contains(p["op"]), p["len"]).otherwise(0)).alias("q"),
        F.concat(a["out"], F.array(F.struct(p["op"].alias("op"), p["len"].alias("len"), a["r"].alias("r"), a["q"].alias("q")))).alias("out"),
    )
    return F.aggregate(cigar_parts(cigar), start, step)["out"]


def _cigar_length(cigar: Column, ops: str) -> Column:
    counts = F.regexp_extract_all(cigar, F.lit(rf"(\d+)[{ops}]"), F.lit(1))
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, n: a + n.cast("long"))


def query_length(cigar: Column) -> Column:
    return _cigar_length(cigar, "MIS=X")


def reference_length(cigar: Column) -> Column:
    return _cigar_length(cigar, "MDN=X")


def end_position(flag: Column, pos0: Column, cigar: Column) -> Column:
    """0-based exclusive end on the reference; pos + 1 without a length."""
    n = reference_length(cigar)
    return pos0 + F.when(has(flag, 4) | (n == 0), F.lit(1).cast("long")).otherwise(n)


def flag_string(flag: Column) -> Column:
    """Comma-joined names of the set bits."""
    names = F.array(*[F.when(has(flag, 1 << i), F.lit(n)) for i, n in enumerate(FLAG_NAMES)])
    return F.array_join(F.filter(names, lambda x: x.isNotNull()), ",")


def flag_number(names: Column) -> Column:
    """The flag of comma-joined names."""
    bits = F.create_map(*[x for i, n in enumerate(FLAG_NAMES) for x in (F.lit(n), F.lit(1 << i))])
    return F.aggregate(F.split(names, ","), F.lit(0), lambda a, n: a.bitwiseOR(F.coalesce(F.element_at(bits, n), F.lit(0))))


def aux_get(aux: Column, tag: str) -> Column:
    """Text of an optional field stored as TYPE:VALUE."""
    return F.substr(F.element_at(aux, F.lit(tag)), F.lit(3))


def aux_type(aux: Column, tag: str) -> Column:
    return F.substr(F.element_at(aux, F.lit(tag)), F.lit(1), F.lit(1))


def aux_int(aux: Column, tag: str) -> Column:
    return F.when(aux_type(aux, tag) == "i", aux_get(aux, tag).try_cast("bigint"))


def aux_float(aux: Column, tag: str) -> Column:
    return F.when(aux_type(aux, tag).isin("f", "i"), aux_get(aux, tag).try_cast("double"))


def aux_array(aux: Column, tag: str) -> Column:
    """Numbers of a B array."""
    return F.when(aux_type(aux, tag) == "B", F.transform(F.slice(F.split(aux_get(aux, tag), ","), 2, 1 << 30), lambda x: x.try_cast("double")))


def aux_set(aux: Column, tag: str, kind: str, value: Column) -> Column:
    """Add or replace a field."""
    rest = F.map_filter(aux, lambda k, _: k != tag)
    return F.map_concat(rest, F.create_map(F.lit(tag), F.concat(F.lit(kind + ":"), value.cast("string"))))


def aux_drop(aux: Column, tag: str) -> Column:
    return F.map_filter(aux, lambda k, _: k != tag)
