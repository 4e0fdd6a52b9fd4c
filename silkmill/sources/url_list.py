"""URL lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silkmill.functions.urls import invalid_reason


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """``pos, url`` of a text file: trimmed, without blank lines, comments and invalid URLs; order and repeats stay.

    A list without a valid URL is an error.
    """
    lines = spark.read.text(path).withColumn("pos", F.monotonically_increasing_id())
    out = valid_urls(lines.withColumnRenamed("value", "line"))
    if out.isEmpty():
        raise ValueError(f"{path} holds no valid URL")
    return out


def valid_urls(lines: DataFrame) -> DataFrame:
    """``pos, url`` from ``pos, line``."""
    rows = lines.select("pos", F.regexp_replace("line", r"^[\s\u0085\u00A0]+|[\s\u0085\u00A0]+\z", "").alias("url"))
    rows = rows.where((F.col("url") != "") & ~F.startswith("url", F.lit("#")))
    return rows.where(invalid_reason(F.col("url")).isNull())
