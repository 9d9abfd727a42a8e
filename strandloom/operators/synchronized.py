"""Records of many variant tables, read side by side.

At each position the tables' records are put into sets with at most one record of each table;
which alleles may share a set is a matter of ``pairing``.  Tables meet in one shuffle by
position; a position with records of one table, or with one record, needs no pairing and stays
in SQL.  The others go through ``pair_position``, a position at a time, in Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .variants import INDEL, MNP, OTHER, REF, SNP, record_type

PAIRINGS = ("exact", "snps", "indels", "any", "some", "snp_ref", "indel_ref", "both", "both_ref")
# Kinds of variants as bits, for pairing.
_REF, _SNP, _INDEL, _OTHER = 1, 2, 4, 8
_BEST = 1 << 40


def _kind(types: int) -> int:
    """Kinds of a record's variant types; breakends and overlaps have none."""
    if types == REF:
        return _REF
    return (_SNP if types & (SNP | MNP) else 0) | (_INDEL if types & INDEL else 0) | (_OTHER if types & OTHER else 0)


class Pairing:
    """How well two kinds go together: 0 not at all, 3 as variants of one kind."""

    def __init__(self, wanted: tuple[str, ...]):
        unknown = set(wanted) - set(PAIRINGS)
        if unknown or not wanted:
            raise ValueError(f"pairing must be of {', '.join(PAIRINGS)}, not {sorted(unknown)}")
        names = set(wanted)
        names |= {"snps", "indels"} if names & {"both", "both_ref"} else set()
        names |= {"snp_ref", "indel_ref"} if "both_ref" in names else set()
        self.exact, self.any = "exact" in names, "any" in names
        if self.any:
            names |= {"snps", "indels", "snp_ref", "indel_ref"}
        self.single = {}
        for name, a, b, score in (("snps", _SNP, _SNP, 3), ("indels", _INDEL, _INDEL, 3), ("snp_ref", _SNP, _REF, 2), ("indel_ref", _INDEL, _REF, 2)):
            if name in names:
                self.single[a, b] = self.single[b, a] = score

    def score(self, a: int, b: int) -> int:
        if (a, b) in self.single:
            return self.single[a, b]
        if self.any:
            return 1
        bits = lambda k: [1 << i for i in range(4) if k >> i & 1]
        return max((self.single.get((x, y), 0) for x in bits(a) for y in bits(b)), default=0)


@dataclass
class _Variant:
    """A record's alleles and the records that have them, by table."""

    alleles: tuple[str, ...]
    kind: int
    at: dict[int, int] = field(default_factory=dict)

    def __post_init__(self):
        self.folded = frozenset(x.upper() for x in self.alleles)


def _together(a: list[_Variant], b: list[_Variant], pairing: Pairing) -> int:
    """How well two sets go together; the least compatible members decide."""
    least = None
    for x in a:
        for y in b:
            if pairing.exact:
                if x.kind == y.kind and (x.alleles == y.alleles or (len(x.alleles) == len(y.alleles) and x.folded <= y.folded)):
                    return _BEST
                continue
            if (x.kind == y.kind and x.alleles == y.alleles) or (x.kind & y.kind and x.folded & y.folded):
                return _BEST
            score = pairing.score(x.kind, y.kind)
            if not score:
                return 0
            least = score if least is None else min(least, score)
    if least is None:
        return 0
    return (1 << (28 + least)) + sum(len(v.at) for v in (*a, *b))


def pair_position(records: list[tuple[int, str, list[str], int]], pairing: Pairing) -> list[dict[int, int]]:
    """Sets of records of one position, each as {table: index}, from records (table, ref, alts,
    variant types) in the order of tables.

    Records with the same alleles are one variant, a table's repeated ones further variants.
    The variant that most tables have goes first: it takes in, as long as there is one, the set
    that goes best with it and whose tables never show any of its variants.
    """
    variants: dict[tuple, _Variant] = {}
    shown: dict[int, list] = {}
    for i, (table, ref, alts, types) in enumerate(records):
        alleles = tuple(f"{ref}>{a}" for a in alts) or (f"{ref}>.",)
        copy = 0
        while table in (found := variants.setdefault((alleles, copy), _Variant(alleles, _kind(types)))).at:
            copy += 1
        found.at[table] = i
        shown.setdefault(table, []).append((alleles, copy))
    # tables that show the same variants are alike
    alike = {t: frozenset(keys) for t, keys in shown.items()}
    left = [([v], {alike[t] for t in v.at}) for v in variants.values()]
    out = []
    while left:
        count = [sum(len(v.at) for v in members) for members, _ in left]
        top = count.index(max(count))
        scores = [0 if others & left[top][1] else _together(left[top][0], members, pairing) for members, others in left]
        best = max(scores)
        if best:
            a, b = sorted((top, scores.index(best)))
            left[a] = (left[a][0] + left[b][0], left[a][1] | left[b][1])
            del left[b]
        else:
            out.append({t: i for v in left.pop(top)[0] for t, i in v.at.items()})
    return out


def synchronize(tables: list[DataFrame], pairing: tuple[str, ...] = ("exact",)) -> DataFrame:
    """chr, pos and ``records``: for each set an array with the record (ref, alts) of each table,
    null where it has none.

    Tables have chr, pos, ref and alts, and ``ord`` if the order of records at a position is to be
    the file's; it is that of ref and alts else.  Rows without a place stay alone.
    """
    logic, n = Pairing(tuple(pairing)), len(tables)
    sides = [t.select("chr", "pos", F.lit(i).alias("table"), (F.col("ord") if "ord" in t.columns else F.lit(0)).cast("bigint").alias("ord"), "ref", "alts") for i, t in enumerate(tables)]
    rows = sides[0]
    for side in sides[1:]:
        rows = rows.unionByName(side)
    placed = F.col("chr").isNotNull() & F.col("pos").isNotNull()
    record = F.struct("table", "ord", "ref", "alts", record_type(F.col("ref"), F.col("alts")).alias("types"))
    groups = rows.where(placed).groupBy("chr", "pos").agg(F.array_sort(F.collect_list(record)).alias("found"), F.count_distinct("table").alias("seen"))
    alone = groups.where("seen = 1").select("chr", "pos", F.explode("found").alias("r")).unionByName(rows.where(~placed).select("chr", "pos", record.alias("r")))
    empty = F.lit(None).cast("struct<ref:string,alts:array<string>>")
    short = lambda r: F.struct(r["ref"].alias("ref"), r["alts"].alias("alts"))
    single = alone.select("chr", "pos", F.array(*[F.when(F.col("r.table") == i, short(F.col("r"))).otherwise(empty) for i in range(n)]).alias("records"))

    def run(batches):
        for batch in batches:
            sets = []
            for found in batch.column(2).to_pylist():
                paired = pair_position([(r["table"], r["ref"], r["alts"] or [], r["types"] or 0) for r in found], logic)
                sets.append([[s.get(t) for t in range(n)] for s in paired])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sets, pa.list_(pa.list_(pa.int32())))], names=["chr", "pos", "found", "sets"])

    several = groups.where("seen > 1").select("chr", "pos", "found")
    found_type = several.schema["found"].dataType.simpleString()
    paired = several.mapInArrow(run, f"chr string, pos bigint, found {found_type}, sets array<array<int>>").select("chr", "pos", "found", F.explode("sets").alias("s"))
    met = paired.select("chr", "pos", F.transform("s", lambda i: F.when(i.isNull(), empty).otherwise(short(F.get("found", i)))).alias("records"))
    return met.unionByName(single)


def targets_by_alleles(table: DataFrame, targets: DataFrame) -> DataFrame:
    """Records (chr, pos, ref, alts) at a target (chr, pos, alleles) of their own sort: an indel
    target, one with an allele of several letters, takes indels, any other the rest."""
    wanted = targets.select(F.col("chr").alias("_t_chr"), F.col("pos").alias("_t_pos"), F.exists("alleles", lambda a: F.length(a) > 1).alias("_t_indel")).distinct()
    indel = record_type(F.col("ref"), F.col("alts")).bitwiseAND(F.lit(INDEL)) != 0
    return table.join(wanted, (F.col("chr") == F.col("_t_chr")) & (F.col("pos") == F.col("_t_pos")) & (indel == F.col("_t_indel")), "left_semi")


def sweep(table: DataFrame, backward: bool = False) -> DataFrame:
    """Records in the order of their places, or in the opposite one."""
    keys = [F.col(c) for c in ("chr", "pos", *(["ord"] if "ord" in table.columns else []))]
    return table.orderBy(*[k.desc() for k in keys] if backward else keys)
