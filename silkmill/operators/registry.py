"""Hashes of all files of earlier runs: a bucketed table against which the files of a new run are marked.

The table is bucketed by hash and partitioned by run.  A run joins it bucket by bucket, so that of the table
nothing is shuffled, however many runs there were; bodies of earlier files are not kept and not read.  A run writes only
hashes that are new, into a partition of its own, which counts once its mark is there: a run that is broken off or repeated
changes nothing.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silkmill.operators.dedupe import first_rows, mode_rank
from silkmill.operators.graph import materialise

COLUMNS = "hash STRING, target STRING, url STRING, mode STRING, run STRING"


class HashRegistry:
    """The registry in a folder; ``buckets`` holds for the folder's whole life."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.table = f"silkmill_registry_{hashlib.md5(self.folder.encode()).hexdigest()[:16]}"
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        place = self.folder.replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({COLUMNS}) USING parquet PARTITIONED BY (run) CLUSTERED BY (hash) INTO {buckets} BUCKETS LOCATION '{place}/hashes'"
        )
        if self.fs.exists(self._path(f"{self.folder}/hashes")):
            spark.sql(f"ALTER TABLE {self.table} RECOVER PARTITIONS")

    def _mark(self, run: str):
        return self._path(f"{self.folder}/runs/{run}")

    def runs(self) -> list[str]:
        """Runs that are whole."""
        at = self._path(f"{self.folder}/runs")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def known(self, without: str | None = None) -> DataFrame:
        """``hash, target, url, mode, run`` of every hash of a target, once, of all whole runs but one."""
        return self.spark.table(self.table).where(F.col("run").isin([r for r in self.runs() if r != without]))

    def mark(self, files: DataFrame, run: str) -> DataFrame:
        """Adds ``is_duplicate`` and ``duplicate_of``, the URL of the first file with the same bytes.

        The first is one of an earlier run, else the least of this run: static before dynamic, then by ``seq``.  A null target is a
        target, a file without a hash is no duplicate.  A run that was added already is marked as it was then.
        """
        known = self.known(run).select(F.col("hash").alias("_h"), F.col("target").alias("_t"), F.col("url").alias("_earlier"))
        own = files.where(F.col("hash").isNotNull()).select("target", "hash", "mode", "seq", "url")
        first = first_rows(own, ["target", "hash"], [mode_rank(F.col("mode")), F.col("seq")]).where("is_first").select("target", "hash", F.col("url").alias("_first"))
        told = first.join(known, (F.col("hash") == F.col("_h")) & F.col("target").eqNullSafe(F.col("_t")), "left").select(
            F.col("hash").alias("_h"), F.col("target").alias("_t"), "_first", "_earlier"
        )
        told = materialise(told)  # so that adaptive execution can split what many files of one hash make of the last join
        marked = first_rows(files, ["target", "hash"], [mode_rank(F.col("mode")), F.col("seq")])
        out = marked.join(told, (F.col("hash") == F.col("_h")) & F.col("target").eqNullSafe(F.col("_t")), "left")
        late = F.col("hash").isNotNull() & (F.col("_earlier").isNotNull() | ~F.col("is_first"))
        return out.withColumn("is_duplicate", late).withColumn("duplicate_of", F.when(late, F.coalesce("_earlier", "_first"))).drop("is_first", "_h", "_t", "_first", "_earlier")

    def add(self, marked: DataFrame, run: str) -> None:
        """Keeps the hashes of the files of :meth:`mark` that are no duplicates; a run that was added already stays as it is."""
        if not re.fullmatch(r"[\w.-]+", run):
            raise ValueError("a run's name is part of a path: letters, digits, dots, hyphens")
        if self.fs.exists(self._mark(run)):
            return
        new = marked.where(F.col("hash").isNotNull() & ~F.col("is_duplicate")).select("hash", "target", "url", "mode")
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.table} PARTITION (run = '{run}') SELECT * FROM {{new}}", new=new.repartition("hash"))
        self.fs.create(self._mark(run), True).close()
        self.spark.catalog.refreshTable(self.table)

    def forget(self) -> None:
        """Drops the table's name from the session; the folder stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
