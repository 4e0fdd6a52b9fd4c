"""Counts over files and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_mode(files: DataFrame, keys: tuple[str, ...] = ("target", "mode")) -> DataFrame:
    """Files, duplicates and bytes of each target and mode."""
    return files.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("files"), F.count_if("is_duplicate").alias("duplicates"),
        F.sum("size").alias("total_size"),
    )


def with_totals(files: DataFrame, mode: str = "mode") -> DataFrame:
    """Per mode and in all, in one pass; the total's mode is ``all``."""
    out = files.rollup(mode).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("total_size"), F.grouping(mode).alias("is_total"))
    return out.withColumn(mode, F.when(F.col("is_total") == 1, "all").otherwise(F.col(mode))).drop("is_total")


def merged(files: DataFrame, target: str = "target") -> DataFrame:
    """Both modes of a target together; ``total_files`` counts different URLs of files that are no duplicates."""
    return files.groupBy(target).agg(
        F.count_if(F.col("mode") == "static").alias("static_files"), F.count_if(F.col("mode") == "dynamic").alias("dynamic_files"),
        F.count_distinct(F.when(~F.col("is_duplicate"), F.col("url"))).alias("total_files"), F.sum("size").alias("total_size"),
    )


def fake_errors(responses: DataFrame, valid: str = "is_js") -> DataFrame:
    """Responses with an error status that are JavaScript all the same, per target."""
    return responses.groupBy("target").agg(F.count_if((F.col("status") >= 400) & F.col(valid)).alias("fake_http_errors"))


def processed(results: DataFrame, batch: str, order: str, failed: str, keep_going: bool = False) -> DataFrame:
    """Results of a batch that are reached: all, or those up to the first failure.

    The first failure is a minimum per batch, so a long batch is no single task's sort.
    """
    if keep_going:
        return results
    first = results.where(F.col(failed)).groupBy(batch).agg(F.min(order).alias("_stop"))
    out = results.join(first, batch, "left")
    return out.where(F.col("_stop").isNull() | (F.col(order) <= F.col("_stop"))).drop("_stop")


def batch_summary(results: DataFrame, batch: str, failed: str, files: str, size: str) -> DataFrame:
    """Targets, successes, failures, files, bytes and megabytes (two decimals) of each batch."""
    ok = ~F.col(failed)
    out = results.groupBy(batch).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(F.col(failed)).alias("failed"),
        F.coalesce(F.sum(F.when(ok, F.col(files))), F.lit(0)).alias("files"), F.coalesce(F.sum(F.when(ok, F.col(size))), F.lit(0)).alias("total_size"),
    )
    return out.withColumn("total_mb", F.round(F.col("total_size") / 1048576, 2))


def cleanup_counts(files: DataFrame) -> DataFrame:
    """How many files were obfuscated and cleaned, and how many failed."""
    return files.agg(
        F.count_if(F.col("is_obfuscated") & F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed")
    )
