"""Structured Streaming: windowed haplotype counts and a mate buffer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, time: str, key: str, methylated: F.Column, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Reads and methylated reads of each key and event-time window; rows later than ``late``
    behind the newest are dropped and finished windows' state with them."""
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, window), F.col(key).alias("chr"))
    return grouped.agg(F.count("*").alias("cnt"), F.sum(methylated.cast("bigint")).alias("meth")).select(F.col("window.start").alias("window_start"), "chr", "cnt", "meth")


def counts_until_done(spark: SparkSession, path: str, late: str = "36500 days") -> DataFrame:
    """Stream a Parquet table through ``windowed_counts`` until it is read, as a DataFrame.

    Each batch hands on the windows that it changed, in a folder of its own (a repeated batch
    replaces it); a window's last state counts.  The default ``late`` keeps every row, as a
    table's files come in any order; with a shorter one finished windows leave the state.
    """
    from ..sources.scratch import scratch_path

    table = spark.read.parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    single = any(f.rstrip("/").endswith(f"/{name}") for f in table.inputFiles())
    reader = spark.readStream.schema(table.schema)
    events = reader.option("pathGlobFilter", name).parquet(folder) if single else reader.parquet(path)
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    counted = windowed_counts(events, "ts", "event_type", F.when(F.col("value") >= 10, 1).otherwise(0), late=late)
    out, state = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state")
    writer = counted.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", state)
    written = set()

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        written.add(number)

    writer.foreachBatch(keep).start().awaitTermination()
    if not written:  # the source has no rows
        changed = spark.createDataFrame([], "window_start timestamp, chr string, cnt bigint, meth bigint, batch bigint")
    else:
        changed = spark.read.schema("window_start timestamp, chr string, cnt bigint, meth bigint, batch bigint").parquet(out)
    last = changed.groupBy("window_start", "chr").agg(F.max_by(F.struct("cnt", "meth"), "batch").alias("s"))
    return last.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "chr", "s.cnt", "s.meth")
