"""Captured responses, local script files, and what is written from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silkmill import schemas
from silkmill.functions.urls import host

# The two content types that a browser's capture keeps, and what an empty one becomes.
SCRIPT_TYPES = ("application/javascript", "text/javascript")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """A table of captured responses, see ``schemas.RESPONSES``."""
    return spark.read.schema(schemas.RESPONSES).parquet(path)


def captured(responses: DataFrame) -> DataFrame:
    """What a browser session keeps: exactly a script type, or a URL that ends in ``.js``.

    ``content_type`` empty or null becomes the first script type.  With a ``body_base64`` column,
    ``body`` is its decoded value, null where it can't be decoded.
    """
    kind = F.coalesce(F.col("content_type"), F.lit(""))
    out = responses.where(kind.isin(*SCRIPT_TYPES) | F.endswith("url", F.lit(".js")))
    out = out.withColumn("content_type", F.when(kind == "", SCRIPT_TYPES[0]).otherwise(kind))
    if "body_base64" in out.columns:
        out = out.withColumn("body", F.try_to_binary("body_base64", F.lit("base64")))
    return out


def read_scripts(spark: SparkSession, path: str) -> DataFrame:
    """``file_path, size, body`` of script files in a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("file_path"), F.col("length").alias("size"), F.col("content").alias("body"))


def write_bodies(files: DataFrame, path: str) -> None:
    """Bodies as a table by target and source host."""
    files.withColumn("source_host", host(F.col("url"))).write.mode("overwrite").partitionBy("target", "source_host").parquet(path)


def save_checkpoint(frame: DataFrame, path: str) -> None:
    """A crawl's state, see ``schemas.CHECKPOINT``."""
    frame.write.mode("overwrite").json(path)


def load_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CHECKPOINT).option("multiLine", "true").json(path)
