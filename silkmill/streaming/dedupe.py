"""Duplicates in a stream of landed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silkmill.operators.dedupe import content_hash


def landed(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    """A stream of parquet files as they land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def first_contents(stream: DataFrame, body: str = "body", target: str = "target", event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """The first row of each content of a target.

    With an event time, state older than the delay is dropped, so it stays bounded.
    """
    out = stream.withColumn("hash", content_hash(F.col(body)))
    if event_time:
        return out.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([target, "hash"])
    return out.dropDuplicates([target, "hash"])
