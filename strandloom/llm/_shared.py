"""Shared-folder tables and skew-safe group minima used by the operators here.

Intermediate tables are Parquet folders under ``spark.checkpoint.dir``: they cut
lineage, survive lost executors, and are visible to every executor.  When the
setting is absent a temporary folder stands in on one machine (a local master); on a cluster,
whose executors would each write to a disk of their own, that is an error.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Number of slices a hot key is cut into before its rows meet.
SALTS = 64

_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, as a URI without trailing slash."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = sc.applicationId
        if app not in _fallback:
            _fallback[app] = "file://" + tempfile.mkdtemp(prefix="strandloom-")
        configured = _fallback[app]
    return configured.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/strandloom/{label}-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch while a table is stored, and of a row group, which a writer holds.
BATCH_BYTES = "8m"
_ROW_GROUP = {"parquet.block.size": str(32 << 20)}
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder (with ``options``) and read it back.

    Python functions in its plan get Arrow batches of at most BATCH_BYTES meanwhile.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    before = spark.conf.get(_BATCH_CONF, None)
    spark.conf.set(_BATCH_CONF, BATCH_BYTES)
    try:
        df.write.options(**_ROW_GROUP, **options).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_BATCH_CONF)
        else:
            spark.conf.set(_BATCH_CONF, before)
    table = spark.read.schema(df.schema).parquet(path)
    _places[id(table)] = (weakref.ref(table, lambda _, key=id(table): _places.pop(key, None)), path)
    return table


#: Where the tables that ``stored`` returned lie, as long as they are held.
_places: dict[int, tuple] = {}


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no later plan reads; other tables are left alone."""
    for table in tables:
        known = _places.get(id(table))
        if known is not None and known[0]() is table:
            jvm = table.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(known[1])
            place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def stored_files(table: DataFrame) -> list[tuple[str, int]]:
    """URI and bytes of each file of a stored table that is still held."""
    jvm = table.sparkSession._jvm
    place = jvm.org.apache.hadoop.fs.Path(_places[id(table)][1])
    found = place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).listStatus(place)
    files = [(f.getPath().toString(), f.getLen()) for f in found if f.getPath().getName().endswith(".parquet")]
    return sorted(files)


def open_fs(uri: str):
    """A pyarrow filesystem and path for a shared-folder URI (file, hdfs, s3, ...)."""
    from pyarrow import fs

    if uri.startswith("/"):
        uri = "file://" + uri
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


def tidy() -> None:
    """Give a task's freed memory back: Python workers live on for other stages."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def salt(*cols) -> F.Column:
    return F.pmod(F.xxhash64(*cols), F.lit(SALTS)).cast("int")


def with_group_stats(df: DataFrame, keys: list[str], aggs: list, salt_col) -> DataFrame:
    """Attach per-group aggregates to every row without gathering a group in one task.

    ``aggs`` are (partial, final) builders: ``partial`` is an aggregate over rows with
    an alias, ``final`` an aggregate over the partial's column with the same alias.
    A group is spread over up to SALTS slices: the slices' aggregates are combined
    (at most SALTS rows a group) and sent back only to the slices that exist.
    """
    salted = df.withColumn("_salt", salt_col)
    part = salted.groupBy(*keys, "_salt").agg(*[p for p, _ in aggs])
    names = [c for c in part.columns if c not in keys and c != "_salt"]
    whole = (
        part.groupBy(*keys)
        .agg(*[f for _, f in aggs], F.collect_list("_salt").alias("_salts"))
        .select(*keys, *names, F.explode("_salts").alias("_salt"))
    )
    renamed = whole.select(*[F.col(k).alias(f"_g_{k}") for k in keys], F.col("_salt").alias("_g_salt"), *names)
    on = F.col("_salt") == F.col("_g_salt")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_g_{k}"))
    return salted.join(renamed, on).drop("_salt", "_g_salt", *[f"_g_{k}" for k in keys])
