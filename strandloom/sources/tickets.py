"""Download tickets: JSON that names the parts of a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TICKET = "htsget struct<format:string,urls:array<struct<url:string,headers:map<string,string>,class:string>>,md5:string>"


def read_ticket(spark: SparkSession, path: str) -> DataFrame:
    """file, format, part (from 0), url, headers and data of a ticket's parts; ``data`` are the
    bytes of a part that stands in its url (base64 or percent-encoded), else null.

    A file that is no ticket is an error.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", TICKET).alias("t"))
    checked = F.when(F.col("t.htsget.urls").isNull(), F.raise_error(F.concat(F.lit("not a ticket: "), F.col("file")))).otherwise(F.col("t.htsget.urls"))
    parts = text.select("file", F.col("t.htsget.format").alias("format"), F.posexplode(checked).alias("part", "u"))
    url = F.col("u.url")
    body = F.substr(url, F.locate(",", url) + 1)
    coded = F.when(F.regexp_like(url, F.lit("^data:[^,]*;base64,")), F.unbase64(body)).when(url.startswith("data:"), F.url_decode(F.replace(body, F.lit("+"), F.lit("%2B"))).cast("binary"))
    return parts.select("file", "format", "part", url.alias("url"), F.col("u.headers").alias("headers"), coded.alias("data"))
