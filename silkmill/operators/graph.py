"""Connected components by joins of minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silkmill.session import shared_folder

#: Rounds after which component search gives up; each at least halves the longest chain.
MAX_ROUNDS = 60
#: Hint of joins whose sides grow with the input: the driver builds no table of them, whatever the session lets it broadcast.
SHUFFLED = "merge"


def materialise(frame: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: lineage ends, lost executors don't matter."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def _fingerprint_of(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("u", "v")).alias("x"),
    ).first()
    return row["n"], row["x"] or 0


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected ``edges`` as ``(node, label)``; label is the least node.

    Alternating star contraction: each node hands its larger neighbours to its least
    neighbour, then its smaller ones.  Both steps are a minimum per key, combined before
    the shuffle, and a join with one row per key, so a hub is no single task's load and
    no pair within a group is ever formed.  Null ends and self-links are ignored; nodes
    without a link are not in the result.  Every round ends in a reliable checkpoint.
    """
    pairs = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where((F.col(a).isNotNull()) & (F.col(b).isNotNull()) & (F.col("u") > F.col("v")))
        .distinct()
    )
    pairs = materialise(pairs)
    seen = _fingerprint_of(pairs)
    for _ in range(MAX_ROUNDS):
        if seen[0] == 0:
            break
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where(F.col("v") > F.col("u"))
            .join(least.hint(SHUFFLED), "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least.hint(SHUFFLED), "u")
        small = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small_least.select("u", F.col("m").alias("v")))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        pairs = materialise(small)
        now = _fingerprint_of(pairs)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    heads = pairs.select(F.col("v").alias("node")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        heads.select("node", F.col("node").alias("label"))
    )
