"""Depth and index statistics over alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alignment import cigar_parts, cigar_runs, has, reference_length
from ..schema import EXCLUDED, UNMAPPED


def aligned_positions(alignments: DataFrame, client: Column | None = None) -> DataFrame:
    """ord, chr, position (1-based), base and kind (M, D or N) at every reference position
    of every usable read, by its CIGAR.  ``client`` is made once of each read and goes with all
    its positions, in a column of that name."""
    reads = alignments.where(F.col("flag").bitwiseAND(F.lit(EXCLUDED)) == 0).where(F.col("cigar") != "*")
    more = []
    if client is not None:
        reads, more = reads.withColumn("client", client), ["client"]
    walk = F.aggregate(
        cigar_parts(F.col("cigar")),
        F.struct(F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("q"), F.expr("cast(array() as array<struct<op:string,len:bigint,r:bigint,q:bigint>>)").alias("out")),
        lambda a, p: F.struct(
            (a["r"] + F.when(F.lit("MDN=X").contains(p["op"]), p["len"]).otherwise(0)).alias("r"),
            (a["q"] + F.when(F.lit("MIS=X").contains(p["op"]), p["len"]).otherwise(0)).alias("q"),
            F.when(F.lit("MDN=X").contains(p["op"]), F.concat(a["out"], F.array(F.struct(p["op"].alias("op"), p["len"].alias("len"), a["r"].alias("r"), a["q"].alias("q"))))).otherwise(a["out"]).alias("out"),
        ),
    )
    runs = reads.withColumn("_p", F.explode(walk["out"]))
    each = runs.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_p.len") - 1)))
    match = F.col("_p.op").isin("M", "=", "X")
    base = F.when(match, F.substr(F.col("seq"), (F.col("_p.q") + F.col("_i") + 1).cast("int"), F.lit(1)))
    return each.select("ord", "chr", (F.col("pos") + F.col("_p.r") + F.col("_i") + 1).alias("position"), base.alias("base"), F.when(match, "M").otherwise(F.col("_p.op")).alias("kind"), *more)


def bases_at(alignments: DataFrame, sites: DataFrame, width: int = 64) -> DataFrame:
    """ord, chr, position and base of every usable read at the sites (chr, pos) where it is aligned:
    the rows of kind M of ``aligned_positions`` there, without those elsewhere.

    Aligned runs are cut at bins, each piece with its own bases, and meet the bin's sites.
    """
    reads = alignments.where(F.col("flag").bitwiseAND(F.lit(EXCLUDED)) == 0).where(F.col("cigar") != "*")
    matched = F.filter(cigar_runs(F.col("cigar")), lambda p: p["op"].isin("M", "=", "X") & (p["len"] > 0))
    runs = reads.select("ord", "chr", "pos", "seq", F.explode(matched).alias("_p"))
    runs = runs.select("ord", "chr", "seq", (F.col("pos") + F.col("_p.r") + 1).alias("_beg"), (F.col("pos") + F.col("_p.r") + F.col("_p.len")).alias("_end"), F.col("_p.q").alias("_q"))
    dealt = runs.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_beg") / width), F.floor(F.col("_end") / width))))
    lo, hi = F.greatest("_beg", F.col("_bin") * width), F.least("_end", F.col("_bin") * width + width - 1)
    pieces = dealt.select("ord", "chr", "_bin", lo.alias("_lo"), hi.alias("_hi"), F.substr("seq", (F.col("_q") + lo - F.col("_beg") + 1).cast("int"), (hi - lo + 1).cast("int")).alias("_bases"))
    points = sites.select(F.col("chr").alias("_s_chr"), F.col("pos").alias("position"), F.floor(F.col("pos") / width).alias("_s_bin"))
    on = (F.col("chr") == F.col("_s_chr")) & (F.col("_bin") == F.col("_s_bin")) & (F.col("position") >= F.col("_lo")) & (F.col("position") <= F.col("_hi"))
    return pieces.join(points, on).select("ord", "chr", "position", F.substr("_bases", (F.col("position") - F.col("_lo") + 1).cast("int"), F.lit(1)).alias("base"))


def _coverage(spans: DataFrame, counts: list[str]) -> DataFrame:
    """chr, position and the sum of each of ``counts`` over the spans (chr, lo, hi) that hold the
    position; the first of them is 1 in every span.

    Each span adds its counts at its first and takes them off behind its last position; running
    sums within bins, on top of the spans that reach into the bin, give those of each run.
    """
    from pyspark.sql import Window

    width = 1 << 14
    dealt = spans.where("lo <= hi").withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    start, end = F.greatest("lo", F.col("bin") * width), F.least("hi", F.col("bin") * width + width - 1)
    step = lambda at, sign: F.struct(at.alias("at"), *[(sign * F.col(c)).alias(c) for c in counts])
    steps = dealt.select("chr", "bin", F.explode(F.array(step(start, 1), step(end + 1, -1))).alias("s"))
    summed = steps.groupBy("chr", "bin", F.col("s.at").alias("at")).agg(*[F.sum(f"s.{c}").alias(c) for c in counts])
    order = Window.partitionBy("chr", "bin").orderBy("at")
    runs = summed.withColumns({**{c: F.sum(c).over(order) for c in counts}, "upto": F.lead("at").over(order) - 1}).where(F.col(counts[0]) > 0)
    return runs.select("chr", F.explode(F.sequence("at", "upto")).alias("position"), *counts)


def depth(alignments: DataFrame) -> DataFrame:
    """Reads at every position, from span ends alone (no read is expanded to its bases)."""
    reads = alignments.where(F.col("flag").bitwiseAND(F.lit(EXCLUDED)) == 0)
    span = F.when(F.col("cigar") == "*", F.length("seq")).otherwise(reference_length(F.col("cigar"))).cast("long")
    return _coverage(reads.select("chr", (F.col("pos") + 1).alias("lo"), (F.col("pos") + span).alias("hi"), F.lit(1).alias("depth")), ["depth"])


def sample_depths(alignments: DataFrame, sample: str, names: list[str]) -> DataFrame:
    """Depth by position with a column for each sample, at every position that a read of any
    sample covers.  A read without a CIGAR covers none; deletions and skips count."""
    reads = alignments.where(F.col("flag").bitwiseAND(F.lit(EXCLUDED)) == 0).where(F.col("cigar") != "*")
    own = [F.coalesce((F.col(sample) == n).cast("int"), F.lit(0)).alias(f"_n{i}") for i, n in enumerate(names)]
    spans = reads.select("chr", (F.col("pos") + 1).alias("lo"), (F.col("pos") + reference_length(F.col("cigar"))).alias("hi"), F.lit(1).alias("_any"), *own)
    covered = _coverage(spans, ["_any", *[f"_n{i}" for i in range(len(names))]])
    return covered.select("chr", "position", *[F.col(f"_n{i}").alias(n) for i, n in enumerate(names)])


def index_statistics(alignments: DataFrame) -> DataFrame:
    """Mapped and unmapped reads of each sequence."""
    unmapped = has(F.col("flag"), UNMAPPED)
    return alignments.groupBy("chr").agg(F.count_if(~unmapped).alias("mapped"), F.count_if(unmapped).alias("unmapped"))


def reconcile_overlap(pileup: DataFrame) -> DataFrame:
    """Qualities where mates cover one position (chr, qname, position, ord, base, q).

    Equal bases: the sum, 200 at most, on the first mate, 0 on the second.  Unequal: the
    better keeps four fifths (ties: the first), the other 0.
    """
    from pyspark.sql import Window

    both = Window.partitionBy("chr", "qname", "position")
    order = both.orderBy("ord")
    marked = pileup.withColumns({"_n": F.count("*").over(both), "_rn": F.row_number().over(order), "_other": F.coalesce(F.lag("q").over(order), F.lead("q").over(order)), "_same": F.min("base").over(both) == F.max("base").over(both)})
    wins = (F.col("q") > F.col("_other")) | ((F.col("q") == F.col("_other")) & (F.col("_rn") == 1))
    new = F.when(F.col("_n") != 2, F.col("q")).when(F.col("_same"), F.when(F.col("_rn") == 1, F.least(F.col("q") + F.col("_other"), F.lit(200))).otherwise(0)).when(wins, F.floor(F.col("q") * 0.8)).otherwise(0)
    return marked.select(*pileup.columns, new.cast("int").alias("q_new"))
