"""Temperature mixing of sources.

Shares of tokens p are raised to an exponent a (0 to 1; up to SHARPEST for a low target
entropy) and normalised: w = p^a / sum p^a.
The exponent is bisected (many exponents in each pass over the table of sources) to meet
either a target entropy or the largest number of epochs that any source may be repeated.
The weights are realised as block permutations: a source's documents are ordered by a keyed
hash, cut into hash blocks; every document appears floor(epochs) times and the documents at
the head of the permutation once more, as far as the source's token budget goes.

Only per-source figures meet the documents (broadcast up to MAX_BROADCAST_SOURCES rows, by a
salted join beyond), so texts are never shuffled, and a source with a third of all rows
is summed block by block (at most 2^16 blocks a source).

Cases: a null source is a source of its own; null and empty texts have no tokens and
appear once whatever the weights; repeated rows share their fate; an empty table stays
empty; an only source gets weight 1.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import SALTS, stored

MAX_BROADCAST_SOURCES = 100_000
BLOCK_BITS = 16
SHARPEST = 16.0
WORDS = r"[^ \t-\r]+"


def count_tokens(text) -> F.Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def token_table(docs: DataFrame) -> DataFrame:
    """doc_id, source and n_tokens of every row, a stored table: the texts are read once."""
    return stored(docs.select("doc_id", "source", count_tokens(F.col("text")).alias("n_tokens")), "mix-tokens")


def _keyed(docs: DataFrame, seed: int, tokens: str | None) -> DataFrame:
    """docs with source key, block and place in the permutation, number of tokens and whether it
    is not 0; the number is left out of plans that do not use it."""
    number = count_tokens(F.col("text")) if tokens is None else F.col(tokens)
    some = F.coalesce(F.rlike("text", F.lit(WORDS)), F.lit(False)) if tokens is None else F.col(tokens) > 0
    return docs.withColumns({
        "_src": F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")),
        "_tokens": number,
        "_some": some,
        "_h": F.xxhash64(F.lit(seed), F.col("doc_id")),
    }).withColumn("_block", F.shiftright("_h", 64 - BLOCK_BITS).cast("int"))


def _sums(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """(sum p^a, sum p^a ln p) for each exponent, in one pass."""
    logp = F.log("p")
    row = shares.agg(*[f(F.exp(logp * a) * w).alias(f"{k}{i}") for i, a in enumerate(exponents) for k, w, f in (("z", F.lit(1.0), F.sum), ("l", logp, F.sum))]).first()
    return [(row[f"z{i}"], row[f"l{i}"]) for i in range(len(exponents))]


def find_exponent(shares: DataFrame, smallest: float, largest: float, max_epochs: float | None, entropy: float | None, cover: bool, passes: int = 6, grid: int = 32) -> float:
    """The least exponent (flattest mix) that keeps the target.

    max_epochs: the rarest source is repeated so often at most.  entropy: the mix's
    entropy in nats is so much at most.  Both fall as the exponent grows.
    """
    lo, hi = 0.0, 1.0 if entropy is None else SHARPEST
    for _ in range(passes):
        tried = [lo + (hi - lo) * i / grid for i in range(grid + 1)]
        fit = []
        for a, (z, zl) in zip(tried, _sums(shares, tried)):
            if entropy is not None:
                fit.append(math.log(z) - a * zl / z <= entropy + 1e-12)
            else:
                most = (smallest / largest) ** (a - 1) if cover else smallest ** (a - 1) / z
                fit.append(most <= max_epochs + 1e-12)
        first = next((i for i, ok in enumerate(fit) if ok), None)
        if first is None:
            raise ValueError(f"no exponent up to {hi:g} meets the target " + (f"entropy of {entropy}" if entropy is not None else f"of {max_epochs} epochs"))
        if first == 0:
            return tried[0]
        lo, hi = tried[first - 1], tried[first]
    return hi


def mix_sources(docs: DataFrame, max_epochs: float | None = 1.5, entropy: float | None = None, budget: int | None = None, cover: bool = True, seed: int = 7, prefix: str = "", tokens: str | None = None) -> DataFrame:
    """docs with n_tokens, weight, epochs, copies and block (after ``prefix``).

    ``tokens`` names a column that holds the numbers of tokens already (see ``token_table``).  A
    target that no exponent meets raises ValueError.

    The budget of tokens is ``budget``; if it is None, then with ``cover`` the least at which
    every source runs through at least once, else the corpus's own number of tokens.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs, seed, tokens)
    blocks = stored(keyed.groupBy("_src", "_block").agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("docs")), "mix-blocks")
    sources = blocks.groupBy("_src").agg(F.sum("tokens").alias("n")).where("n > 0")
    total = sources.agg(F.sum("n")).first()[0] or 0
    shares = stored(sources.withColumn("p", F.col("n") / F.lit(float(max(total, 1)))), "mix-sources")
    ends = shares.agg(F.min("p"), F.max("p"), F.count("*")).first()
    smallest, largest, n_sources = ends[0] or 1.0, ends[1] or 1.0, ends[2]
    a = find_exponent(shares, smallest, largest, max_epochs, entropy, cover and budget is None) if n_sources else 1.0
    z = _sums(shares, [a])[0][0] if n_sources else 1.0
    if budget is None:
        # tokens / weight is greatest for the source with the largest share
        budget = total * z * largest ** (1 - a) if cover else total
    weighted = shares.withColumn("weight", F.exp(F.log("p") * a) / F.lit(z)).withColumn("epochs", F.col("weight") * F.lit(float(budget)) / F.col("n"))
    # a source that the budget just covers has epochs of 1 but for rounding
    weighted = weighted.withColumn("epochs", F.when(F.abs(F.col("epochs") - F.round("epochs")) < 1e-9, F.round("epochs")).otherwise(F.col("epochs")))
    weighted = weighted.withColumn("_extra", (F.col("epochs") - F.floor("epochs")) * F.col("n"))
    plan = stored(_thresholds(keyed, blocks, weighted, tokens is None and n_sources <= MAX_BROADCAST_SOURCES), "mix-plan")
    plan = plan.select(F.col("_src").alias("_p_src"), F.col("weight").alias("_p_weight"), F.col("epochs").alias("_p_epochs"), F.col("_last").alias("_p_last"))
    if n_sources <= MAX_BROADCAST_SOURCES:
        out = keyed.join(F.broadcast(plan), F.col("_src") == F.col("_p_src"), "left")
    else:
        salted = plan.withColumn("_p_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = keyed.withColumn("_salt", F.pmod("_h", F.lit(SALTS))).join(salted, (F.col("_src") == F.col("_p_src")) & (F.col("_salt") == F.col("_p_salt")), "left")
    copies = F.floor("_p_epochs") + F.when(F.col("_h") <= F.col("_p_last"), 1).otherwise(0)
    return out.select(
        *(out[f"`{c}`"] for c in docs.columns if c != f"{prefix}n_tokens" or c != tokens), F.col("_tokens").alias(f"{prefix}n_tokens"), F.coalesce("_p_weight", F.lit(0.0)).alias(f"{prefix}weight"), F.coalesce("_p_epochs", F.lit(1.0)).alias(f"{prefix}epochs"),
        F.when(~F.col("_some"), 1).otherwise(copies).cast("int").alias(f"{prefix}copies"), F.col("_block").alias(f"{prefix}block"),
    )


def _thresholds(keyed: DataFrame, blocks: DataFrame, weighted: DataFrame, by_text: bool) -> DataFrame:
    """For each source the last permutation key that still fits its extra budget."""
    order = Window.partitionBy("_src").orderBy("_block")
    cut = (
        blocks.withColumn("_upto", F.sum("tokens").over(order))
        .join(weighted.select("_src", "_extra"), "_src")
        .where((F.col("_upto") > F.col("_extra")) & (F.col("_upto") - F.col("tokens") <= F.col("_extra")) & (F.col("tokens") > 0))
        .select(F.col("_src").alias("_c_src"), F.col("_block").alias("_c_block"), (F.col("_extra") - (F.col("_upto") - F.col("tokens"))).alias("_room"))
    )
    # the documents of one block of each source: a 2^-16 part of the source's rows; with few
    # sources the others' texts are neither counted again nor shuffled
    place = (F.col("_src") == F.col("_c_src")) & (F.col("_block") == F.col("_c_block"))
    if by_text:
        inner = keyed.select("_src", "_block", "_h", "text").join(F.broadcast(cut), place).withColumn("_tokens", count_tokens(F.col("text")))
    else:
        inner = keyed.select("_src", "_block", "_h", "_tokens").join(cut, place)
    by_key = inner.groupBy("_src", "_h", "_room").agg(F.sum("_tokens").alias("_tokens"))
    run = by_key.withColumn("_sum", F.sum("_tokens").over(Window.partitionBy("_src").orderBy("_h")))
    last = run.groupBy("_src").agg(F.max(F.when(F.col("_sum") <= F.col("_room"), F.col("_h"))).alias("_fits"))
    low = cut.select(F.col("_c_src").alias("_src"), F.col("_c_block"))
    # the key just below the cut block; block -2^15 has none
    before = F.when(F.col("_c_block") > -(1 << (BLOCK_BITS - 1)), F.shiftleft(F.col("_c_block").cast("long"), 64 - BLOCK_BITS) - F.lit(1).cast("long"))
    return (
        weighted.join(low, "_src", "left").join(last, "_src", "left")
        .select("_src", "weight", "epochs", F.coalesce("_fits", before).alias("_last"))
    )


def mixed_documents(docs: DataFrame, **targets) -> DataFrame:
    """docs with every row as often as the mix has it."""
    mixed = mix_sources(docs, prefix="_mix_", **targets)
    return mixed.where("_mix_copies > 0").withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select(*docs.columns)


def realise(mixed: DataFrame, seed: int = 7) -> DataFrame:
    """One row for each copy, with ``copy`` and ``position``; ordering by position interleaves
    the sources at their weights.  ``seed`` is that of ``mix_sources``: each pass runs through
    the permutation, so a last part of a pass, the head of it, ends near 1 as the others do."""
    share = (F.xxhash64(F.lit(seed), F.col("doc_id")) / F.lit(2.0**64)) + F.lit(0.5)
    return (
        mixed.where("copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        .withColumn("position", (F.col("copy") + share) / F.greatest("epochs", F.lit(1e-9)))
    )
