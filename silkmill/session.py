"""Spark session with the settings that the operators count on."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "silkmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC, ANSI mode on, adaptive execution on; ``conf`` adds or overrides settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.sql.shuffle.partitions", str(os.cpu_count() or 8))
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.ansi.enabled": "true",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which is also set as the checkpoint folder.

    Unset, it is a temporary folder in local mode; on a cluster executors could not share that, so it is an error.
    """
    context = spark.sparkContext
    have = context._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (have.get() if have.isDefined() else None)
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):  # executors of local-cluster are apart
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="silkmill-checkpoint-")
    if not have.isDefined():
        context.setCheckpointDir(folder)
    return folder


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark reaches."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A new path in the shared folder; what is written there is gone at the end."""
    path = f"{shared_folder(spark).rstrip('/')}/silkmill-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        remove_folder(spark, path)


@contextmanager
def stored(frame: DataFrame) -> Iterator[DataFrame]:
    """``frame`` as a compressed table in the shared folder: computed once, read often, gone at the end."""
    with scratch(frame.sparkSession) as path:
        frame.write.option("compression", "zstd").parquet(path)
        yield frame.sparkSession.read.schema(frame.schema).parquet(path)
