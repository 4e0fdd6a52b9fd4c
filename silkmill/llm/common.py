"""Session settings and materialisation for the operators here."""

from __future__ import annotations

import pickle
import uuid
import zlib

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silkmill.operators.graph import components, materialise
from silkmill.session import shared_folder

__all__ = ["Shared", "as_doc", "components", "from_doc", "hamming", "materialise", "pack", "share", "small_batches", "stored", "unpack"]

#: Bytes of the Arrow batches that workers get, unless the session says otherwise.
BATCH_BYTES = 4 << 20


def stored(frame: DataFrame) -> DataFrame:
    """Like :func:`materialise`, as a compressed table: for wide rows such as texts."""
    path = f"{shared_folder(frame.sparkSession).rstrip('/')}/silkmill-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes: 10,000 rows of long texts would fill the executor and its workers.

    The setting is read when a query runs, so it stays in the session; one that is there already is kept.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def pack(value: object) -> bytes:
    """An object of a class of this package as compressed bytes that carry the class along."""
    return zlib.compress(cloudpickle.dumps(value), 1)


def unpack(packed: bytes) -> object:
    """The object that :func:`pack` got."""
    return pickle.loads(zlib.decompress(packed))


class Shared:
    """A broadcast object, packed, as workers keep it."""

    def __init__(self, spark: SparkSession, packed: bytes):
        self.packed = spark.sparkContext.broadcast(packed)

    def load(self) -> object:
        """The object; to be called once in a task."""
        return unpack(self.packed.value)


def share(spark: SparkSession, value: object) -> Shared:
    """Broadcasts ``value``, so that executors without this package can load it; bytes are one that a task has packed."""
    return Shared(spark, value if isinstance(value, bytes) else pack(value))


def as_doc(docs: DataFrame) -> Column:
    """A row's columns as one struct ``doc``, so that no name of theirs meets a name of ours."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")


def from_doc(docs: DataFrame, *less: str) -> list[Column]:
    """The columns of ``docs`` again, out of the struct, but for those in ``less``."""
    return [F.col("doc").getField(c).alias(c) for c in docs.columns if c not in less]


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two longs."""
    return F.bit_count(a.bitwiseXOR(b))
