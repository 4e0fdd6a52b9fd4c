"""Exact duplicates by content hash; the first arrival wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def content_hash(body: Column) -> Column:
    """Lower-case hex SHA-256 of the bytes."""
    return F.sha2(body.cast("binary"), 256)


def mode_rank(mode: Column) -> Column:
    """Static files come before dynamic ones."""
    return F.when(mode == "static", 0).otherwise(1)


def first_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Adds ``is_first``: true for one row of each key, the least in ``order``; of repeated rows one is it.

    The least is a minimum per key, combined before the shuffle.  Rows then meet it by key and
    order together, so a key with very many rows is spread over all tasks, and a window tells rows apart only where
    they are equal in key, order and all other columns that can be compared.  Null keys are a key, null in the order comes last.
    """
    flat = [F.struct(o.isNull().alias("n"), o.alias("v")) for o in order]
    plain = [F.col(f"`{c}`") for c in rows.columns if not rows.schema[c].dataType.simpleString().startswith(("map", "variant"))]
    marked = rows.select("*", F.struct(*flat, F.xxhash64(*plain)).alias("_order"), F.struct(*[F.col(k).alias(f"k{n}") for n, k in enumerate(keys)]).alias("_key"))
    least = marked.groupBy("_key").agg(F.min("_order").alias("_order")).withColumn("_least", F.lit(True))
    met = marked.join(least, ["_key", "_order"], "left")
    same = W.partitionBy("_key", "_order").orderBy("_least")
    first = F.coalesce(F.col("_least"), F.lit(False)) & (F.row_number().over(same) == 1)
    return met.select(*[f"`{c}`" for c in rows.columns], first.alias("is_first"))


def first_by_url(files: DataFrame, keys: tuple[str, ...] = ("target", "mode", "url"), seq: str = "seq") -> DataFrame:
    """One row for each URL of a target and mode: the first to arrive; rows without ``seq`` come last.

    Where keys leave the mode out, static comes first.  Of rows that arrive together a digest of all columns
    chooses, of repeated rows one stays.
    """
    order = [F.col(seq)] if "mode" in keys or "mode" not in files.columns else [mode_rank(F.col("mode")), F.col(seq)]
    return first_rows(files, keys, order).where("is_first").drop("is_first")


def mark_duplicates(files: DataFrame, target: str = "target", mode: str = "mode", seq: str = "seq", hash_: str = "hash") -> DataFrame:
    """Adds ``is_duplicate``: all but the first file of a target with the same bytes.

    Static before dynamic, then by ``seq``; what is equal in these, repeated rows included, is told apart as in
    :func:`first_rows`.  A null target is a target; a file without a hash is no duplicate.
    """
    out = first_rows(files, [target, hash_], [mode_rank(F.col(mode)), F.col(seq)])
    return out.withColumn("is_duplicate", F.col(hash_).isNotNull() & ~F.col("is_first")).drop("is_first")


def duplicate_groups(files: DataFrame, hash_: str = "hash", key: str = "url", size: str = "size") -> DataFrame:
    """``hash, n, first, saved`` of every content that stands in two or more files."""
    out = files.groupBy(hash_).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"), F.max(size).alias("size"))
    return out.where("n > 1").select(hash_, "n", "first", (F.col("size") * (F.col("n") - 1)).alias("saved"))


def cross_mode(files: DataFrame, mode: str = "mode", hash_: str = "hash") -> DataFrame:
    """Dynamic files whose bytes a static file has too."""
    static = files.where(F.col(mode) == "static").select(hash_)
    return files.where(F.col(mode) == "dynamic").join(static, hash_, "left_semi")
