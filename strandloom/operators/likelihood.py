"""Genotype likelihoods of pileup columns under a dependent-error model.

A column's bases are summed by base, strand and quality first, so that a position of any depth
is a few hundred rows at most, and stay summed: what a row's bases cost is one product of their
weights with a stretch of the costs of one more error among n bases of one quality.  Those
depend on (quality, n) only and are kept, up to a bound, for the next rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.statistics import log_factorial

ALLELES = "ACGT"
# Fixed constants of the model: dependency between errors on a strand, its floor, the range of
# qualities, and ten over the logarithm of ten.
DEPENDENCY, FLOOR, LEAST_Q, MOST_Q, PHRED = 0.17, 0.03, 4, 63, 4.343
#: Costs that a task keeps (one column of more bases has more).
KNOWN_COSTS = 4_000_000


def error_costs(quality: int, n: int) -> np.ndarray:
    """For k = 0 .. n - 1 errors so far, the phred cost of one more among n bases of one quality:
    the ratio of the binomial tails from k + 1 and from k on."""
    e = 10 ** (-quality / 10)
    k = np.arange(n + 1)
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
    log_p = logs[n] - logs - logs[::-1] + k * math.log(e) + (n - k) * math.log1p(-e)
    tail = np.logaddexp.accumulate(log_p[::-1])[::-1]
    return -10 / math.log(10) * np.diff(tail)


def _spent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (base, q, n, m, _k, _j, ...) with ``spent``: what the m bases cost that follow _k better
    ones, _j of them on their strand."""
    known: dict[tuple[int, int], np.ndarray] = {}
    held, weight = 0, np.zeros(0)
    for batch in batches:
        q, n, m, k, j = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("q", "n", "m", "_k", "_j"))
        most = int((j + m).max(initial=0))
        if most > len(weight):
            weight = (1 - DEPENDENCY) ** np.arange(most) * (1 - FLOOR) + FLOOR
        spent = np.zeros(batch.num_rows)
        for i, base in enumerate(batch.column("base").to_pylist()):
            if base is None or base not in ALLELES:
                continue
            key = (int(q[i]), int(n[i]))
            cost = known.get(key)
            if cost is None:
                if held > KNOWN_COSTS:
                    known.clear()
                    held = 0
                cost = known[key] = error_costs(*key)
                held += len(cost)
            spent[i] = weight[j[i] : j[i] + m[i]] @ cost[k[i] : k[i] + m[i]]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spent)], names=[*batch.schema.names, "spent"])


def genotype_likelihoods(pileup: DataFrame) -> DataFrame:
    """Of pileup rows (chr, position, base, q, reverse): depth and the ten genotypes' phred-scaled
    likelihoods of each position.

    Within a base the best quality comes first, at one quality the reverse strand; each further
    base on the same strand weighs less.  Other letters count in the depth only.
    """
    place = ["chr", "position"]
    q = F.least(F.greatest("q", F.lit(LEAST_Q)), F.lit(MOST_Q)).cast("int")
    same = pileup.select(*place, "base", q.alias("q"), "reverse").groupBy(*place, "base", "q", "reverse").agg(F.count("*").alias("m"))
    # few rows cost much, so their number of tasks is not left to their size
    same = same.repartition(int(pileup.sparkSession.conf.get("spark.sql.shuffle.partitions")), *place)
    by_base = Window.partitionBy(*place, "base").orderBy(F.desc("q"), F.desc("reverse")).rowsBetween(Window.unboundedPreceding, -1)
    by_strand = Window.partitionBy(*place, "base", "reverse").orderBy(F.desc("q")).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda w: F.coalesce(F.sum("m").over(w), F.lit(0))
    ranked = same.withColumns({"n": F.sum("m").over(Window.partitionBy(*place)), "_k": before(by_base), "_j": before(by_strand)})
    costed = ranked.mapInArrow(_spent, StructType([*ranked.schema.fields, StructField("spent", DoubleType())]))
    of = lambda b, c: F.sum(F.when(F.col("base") == b, F.col(c)))
    whole = costed.groupBy(*place).agg(
        F.sum("m").alias("depth"), *[F.coalesce(of(b, "m"), F.lit(0)).alias(f"n_{b}") for b in ALLELES], *[F.coalesce(of(b, "spent"), F.lit(0.0)).alias(f"cost_{b}") for b in ALLELES]
    )
    total = sum((F.col(f"cost_{b}") for b in ALLELES), F.lit(0.0))

    def phred(a: str, b: str):
        if a == b:
            return total - F.col(f"cost_{a}")
        both = F.col(f"n_{a}") + F.col(f"n_{b}")
        chance = log_factorial(both) - log_factorial(f"n_{a}") - log_factorial(f"n_{b}") - math.log(2) * both
        return total - F.col(f"cost_{a}") - F.col(f"cost_{b}") - PHRED * chance

    pairs = [(a, b) for i, a in enumerate(ALLELES) for b in ALLELES[i:]]
    rows = F.array(*[F.struct(F.lit(a + b).alias("genotype"), F.greatest(phred(a, b), F.lit(0.0)).alias("phred")) for a, b in pairs])
    return whole.select(*place, "depth", F.explode(rows).alias("g")).select(*place, "depth", "g.genotype", "g.phred")
