"""First wins in a stream whose files arrive out of order: a static file that comes late displaces a dynamic one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State stores that this mechanism needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RESULT = "target string, hash string, mode string, seq long, url string"
STATE = "target string, hash string, rank int, seq long, url string, mode string, end_ms long"
#: Contents are dealt to so many keys; a key's contents are one task's while they are handed out.
BUCKETS = 1024
#: The time for better files ends at a multiple of this part of it, so contents are handed out together.
STEPS = 8


def _best(files: pd.DataFrame) -> pd.DataFrame:
    """The best file of each content, with the earliest end."""
    ends = files.groupby(["target", "hash"], sort=False)["end_ms"].transform("min")
    return files.assign(end_ms=ends).sort_values(["rank", "seq", "url", "mode"]).drop_duplicates(["target", "hash"])


class FirstWins(StatefulProcessor):
    """Of each content of a bucket, keeps the best files so far; hands the best out once, when the time for better ones is over.

    A batch adds its best files to the bucket's list in one call and reads nothing.  When a time is over, the list is read once and keeps
    only the contents whose time is not over, so it holds the contents of that time, however long the stream is.  A content that
    comes again later is a first one again.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.files = handle.getListState("files", STATE)
        self.columns = [x.split()[0] for x in STATE.split(", ")]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        best = None
        for pdf in rows:
            best = _best(pdf[self.columns] if best is None else pd.concat([best, pdf[self.columns]]))
        if best is not None and len(best):
            self.files.appendList(list(best.itertuples(index=False, name=None)))
            for end in best["end_ms"].unique():
                self.handle.registerTimer(int(end))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        known = list(self.files.get())
        if not known:
            return
        best = _best(pd.DataFrame(known, columns=self.columns))
        over = best["end_ms"] <= expiredTimerInfo.getExpiryTimeInMs()
        if not over.any():
            return
        rest = best[~over]
        if len(rest):
            self.files.put(list(rest.itertuples(index=False, name=None)))
        else:
            self.files.clear()
        yield best.loc[over, ["target", "hash", "mode", "seq", "url"]].reset_index(drop=True)

    def close(self) -> None:
        pass


def configure(spark: SparkSession) -> None:
    """Settings that the state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def first_wins(stream: DataFrame, event_time: str, delay: str = "1 hour", hold_seconds: int = 3600, buckets: int = BUCKETS) -> DataFrame:
    """``target, hash, mode, seq, url``: of each content of a target the first file, static before dynamic, then by ``seq``, then by URL.

    ``stream``: ``target, hash, mode, seq, url`` and an event time.  Files that come within ``hold_seconds`` of event time (rounded up to the next eighth of it)
    compete, in whatever order they arrive; files later than ``delay`` behind the stream are dropped.  Rows without a hash, ``seq`` or time are left out, a null target is the empty one.
    Contents are dealt to ``buckets`` keys, whose number a running stream can't change; the contents of one that wait at a time have to fit a task.
    """
    configure(stream.sparkSession)
    hold = hold_seconds * 1000
    after = F.unix_millis(event_time) + hold
    rows = stream.where(F.expr("hash IS NOT NULL AND seq IS NOT NULL") & F.col(event_time).isNotNull()).withWatermark(event_time, delay).select(
        F.coalesce("target", F.lit("")).alias("target"), "hash", F.coalesce("mode", F.lit("")).alias("mode"), F.col("seq").cast("long").alias("seq"), F.coalesce("url", F.lit("")).alias("url"),
        F.when(F.col("mode") == "static", 0).otherwise(1).alias("rank"), (after + F.pmod(-after, F.lit(max(1, hold // STEPS)))).alias("end_ms"), F.col(event_time),
    )
    bucket = F.pmod(F.xxhash64("target", "hash"), F.lit(buckets)).cast("int").alias("bucket")
    return rows.withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(FirstWins(), RESULT, "Append", "EventTime")
