"""Where temporary tables go."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_local: dict[str, str] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under spark.checkpoint.dir, or, with a local master, under a local folder if
    that is unset."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="strandloom-scratch-"))
    return f"{root.rstrip('/')}/strandloom/{label}-{uuid.uuid4().hex}"
