"""Connected components of a distributed edge list, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (columns u, v): the smallest id reachable.

    Every round takes each node's least neighbouring label and then its label's label, and
    writes the labels to the shared folder; the rounds grow with the logarithm of the
    longest path.  Aggregates are combined before they are shuffled, and the lookups are
    plain equi-joins, whose skewed partitions Spark splits.  Tables of past rounds are deleted.
    """
    both = stored(edges.select("u", "v").union(edges.select("v", "u")).where("u <> v").distinct(), "cc-edges")
    labels = stored(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.col("id")).alias("component")), "cc-labels")
    before = labels
    while True:
        heard = both.join(labels, F.col("v") == F.col("id")).groupBy(F.col("u").alias("h_id")).agg(F.min("component").alias("heard"))
        hooked = labels.join(heard, F.col("id") == F.col("h_id")).select("id", F.col("component").alias("was"), F.least("component", "heard").alias("component"))
        hooked = stored(hooked, "cc-hooked")
        up = hooked.select(F.col("id").alias("j_id"), F.col("component").alias("jumped"))
        new = stored(
            hooked.join(up, F.col("component") == F.col("j_id"), "left").select("id", "was", F.least("component", F.coalesce("jumped", "component")).alias("component")),
            "cc-labels",
        )
        discard(hooked, before)
        labels, before = new.select("id", "component"), new
        if not new.where("was <> component").limit(1).count():
            discard(both)
            return labels
