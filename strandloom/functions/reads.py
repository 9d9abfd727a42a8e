"""Per-read functions over CIGARs and bases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .alignment import cigar_parts, cigar_runs
from .statistics import log_factorial


def insertions(pos0: Column, cigar: Column, seq: Column) -> Column:
    """array<struct<position, bases>>: the bases inserted behind each 1-based reference
    position, pads as '*', neighbouring insertions and pads as one."""
    zero = F.lit(0).cast("long")
    empty = F.expr("cast(array() as array<struct<position:bigint,bases:string>>)")
    start = F.struct(zero.alias("r"), zero.alias("q"), F.lit(False).alias("on"), empty.alias("out"))

    def step(a, p):
        n, op = p["len"], p["op"]
        new = F.when(op == "I", F.substr(seq, (a["q"] + 1).cast("int"), n.cast("int"))).otherwise(F.repeat(F.lit("*"), n.cast("int")))
        inside = op.isin("I", "P")
        last = F.element_at(a["out"], -1)
        grown = F.when(
            a["on"], F.concat(F.slice(a["out"], F.lit(1), F.size(a["out"]) - 1), F.array(F.struct(last["position"].alias("position"), F.concat(last["bases"], new).alias("bases"))))
        ).otherwise(F.concat(a["out"], F.array(F.struct((pos0 + a["r"]).alias("position"), new.alias("bases")))))
        return F.struct(
            (a["r"] + F.when(op.isin("M", "D", "N", "=", "X"), n).otherwise(0)).alias("r"),
            (a["q"] + F.when(op.isin("M", "I", "S", "=", "X"), n).otherwise(0)).alias("q"),
            inside.alias("on"),
            F.when(inside, grown).otherwise(a["out"]).alias("out"),
        )

    return F.aggregate(cigar_parts(cigar), start, step)["out"]


# Fixed values of the cap: the least base quality that counts, the most that one counts, what a
# hard-clipped base counts, and ten over the logarithm of ten.
COUNTED, MOST, HARD, PHRED = 13, 33, 13, 4.343


def cap_mapping_quality(reads: DataFrame, limit: int = 40, out: str = "cap") -> DataFrame:
    """``reads`` (cigar, seq, qual, reference) with the mapping quality that each one's mismatches
    allow, -1 for none.

    ``reference`` begins at the read's position; runs behind the first aligned or deleted one
    that passes its end do not count.  With n aligned bases that count (no N on either side,
    quality of COUNTED or more) plus the length of all aligned runs that end within the
    reference, m mismatches among them with qualities that sum to Q (each MOST at most) and
    clipped bases with qualities that sum to C (hard-clipped ones HARD each):
    t = Q - PHRED (m ln n - ln m!) + C / 5, and the cap is ``limit`` scaled by the root of
    (limit - t) / limit, none if t passes the limit.
    """
    size = F.length("reference").cast("long")
    score = lambda at: F.when(F.col("qual") == "*", 255).otherwise(F.ascii(F.substr("qual", (at + 1).cast("int"), F.lit(1))) - 33)
    aligned = lambda x: x["op"].isin("M", "=", "X")
    past = lambda x: (aligned(x) | (x["op"] == "D")) & (x["r"] + x["len"] > size)
    total = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v)

    def bases(x):
        here = F.sequence(F.lit(0).cast("long"), F.greatest(F.least(x["len"], size - x["r"]), F.lit(1)) - 1)
        letter = lambda text, at: F.upper(F.substr(text, (at + 1).cast("int"), F.lit(1)))
        each = F.transform(here, lambda k: F.struct(letter("seq", x["q"] + k).alias("b"), letter("reference", x["r"] + k).alias("o"), score(x["q"] + k).alias("s")))
        return F.filter(each, lambda e: (x["r"] < size) & (x["len"] > 0) & (e["b"] != "N") & (e["o"] != "N") & (e["s"] >= COUNTED))

    runs = reads.withColumn("_runs", cigar_runs(F.col("cigar")))
    stop = F.array_position(F.transform("_runs", past), True).cast("int")
    runs = runs.withColumn("_stop", stop).withColumn("_runs", F.when(F.col("_stop") > 0, F.slice("_runs", F.lit(1), F.col("_stop"))).otherwise(F.col("_runs")))
    counted = runs.withColumn("_bases", F.flatten(F.transform(F.filter("_runs", aligned), bases)))
    whole = total(F.transform(F.filter("_runs", lambda x: aligned(x) & ~past(x)), lambda x: x["len"]))
    soft = F.flatten(F.transform(F.filter("_runs", lambda x: (x["op"] == "S") & (x["len"] > 0)), lambda x: F.transform(F.sequence(x["q"], x["q"] + x["len"] - 1), lambda at: score(at).cast("long"))))
    hard = total(F.transform(F.filter("_runs", lambda x: x["op"] == "H"), lambda x: x["len"] * HARD))
    wrong = F.filter("_bases", lambda e: (e["b"] != "=") & (e["b"] != e["o"]))
    summed = counted.withColumns({"_n": F.size("_bases") + whole, "_wrong": wrong, "_clipped": total(soft) + hard}).withColumns({
        "_m": F.size("_wrong"), "_quality": total(F.transform("_wrong", lambda e: F.least(e["s"], F.lit(MOST)).cast("long"))),
    })
    chance = F.when(F.col("_m") > 0, F.col("_m") * F.log("_n") - log_factorial("_m")).otherwise(0.0)
    scored = summed.withColumn("_t", F.col("_quality") - PHRED * chance + F.col("_clipped") / 5.0)
    cap = F.floor(F.sqrt((limit - F.greatest("_t", F.lit(0.0))) / limit) * limit + 0.499)
    return scored.select(*reads.columns, F.when(F.col("_t") > limit, -1).otherwise(cap).cast("int").alias(out))


def percent_decode(text: Column) -> Column:
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def base64_decode(text: Column) -> Column:
    return F.unbase64(text).cast("string")
