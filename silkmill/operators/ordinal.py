"""Global order without a task that sees everything: running sums over range partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from silkmill.session import shared_folder


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], to: str = "ordinal", weight: Column | None = None) -> DataFrame:
    """Adds ``to``: the sum of ``weight`` (1, if not given) over the rows before, among those of the same keys.

    Rows are dealt out by ranges of keys and order, and checkpointed, so that a partition's number stands for its
    place.  A sum for each partition and key, and sums of these, give what lies before a partition; a window counts
    within one partition and key.  So the rows of one key, or a table without keys, may be of any number.  Null keys are a key,
    null in the order comes first.  Rows that are equal in keys and order follow each other in any order, which stays.
    """
    shared_folder(rows.sparkSession)
    key = F.struct(*keys) if keys else F.lit(0)
    own = F.lit(1).cast("long") if weight is None else weight.cast("long")
    placed = rows.withColumns({"_key": key, "_weight": own}).repartitionByRange("_key", *order).withColumn("_range", F.spark_partition_id()).checkpoint()
    earlier = W.partitionBy("_key").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sums = placed.groupBy("_key", "_range").agg(F.sum("_weight").alias("_sum"))
    sums = sums.select("_key", "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    within = W.partitionBy("_key", "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = placed.withColumn("_local", F.coalesce(F.sum("_weight").over(within), F.lit(0)))
    out = local.join(sums, ["_key", "_range"]).withColumn(to, F.col("_before") + F.col("_local"))
    return out.drop("_key", "_range", "_weight", "_local", "_before")
