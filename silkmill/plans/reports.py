"""Reports with statistics, times, configuration and entries, and records of files, by their schemas."""

from __future__ import annotations

from dataclasses import asdict
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silkmill import schemas
from silkmill.functions.urls import extension, host
from silkmill.operators.ordinal import running
from silkmill.plans.assets import cleaned_files, failed_files, script_files, source_map_files, stable_id, success_files, with_paths
from silkmill.session import stored
from silkmill.sources.config import CrawlConfig

#: Entries of each kind in one part of a report.
PART_ENTRIES = 10_000
#: Statistics that count visits and requests, and come with them.
VISITED, FAILED, FAKE = "visited_urls", "failed_files", "fake_http_errors"


def shaped(rows: DataFrame, schema: str) -> DataFrame:
    """``rows`` with the columns of a schema, in its order and of its types; what they lack is null."""
    wanted = rows.sparkSession.createDataFrame([], schema).schema
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def js_files(files: DataFrame, maps: DataFrame | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """Records of script files, see ``schemas.JS_FILES``: files with paths (``assets.with_paths``), and their source maps.

    ``downloaded_at`` is the response's ``fetched_at``, null if it was not captured; ``more``: columns of the files that stay.
    """
    out = files.select("*", F.col("url").alias("source_url"), F.col("mode").alias("crawl_mode"), F.col("is_obfuscated").alias("is_deobfuscated"))
    out = out.withColumn("downloaded_at", F.col("fetched_at") if "fetched_at" in files.columns else F.lit(None).cast("timestamp"))
    if maps is not None:
        of = maps.select(F.col("target").alias("_t"), F.col("js_file_url").alias("_u"), F.col("url").alias("map_file_url"))
        of = of.groupBy("_t", "_u").agg(F.min("map_file_url").alias("map_file_url"))
        out = out.join(of, F.col("target").eqNullSafe(F.col("_t")) & (F.col("url") == F.col("_u")), "left")
        out = out.withColumn("has_map_file", F.col("map_file_url").isNotNull())
    return shaped(out, ", ".join([schemas.JS_FILES, *[f"{c} {dict(files.dtypes)[c]}" for c in more]]))


def map_files(maps: DataFrame) -> DataFrame:
    """Records of source maps, see ``schemas.MAP_FILES``."""
    out = maps.withColumn("id", stable_id("target", "url")).withColumn("extension", extension(F.col("url")))
    return shaped(out, schemas.MAP_FILES)


def statistics(files: DataFrame, failed: DataFrame, maps: DataFrame, visits: DataFrame | None = None, responses: DataFrame | None = None) -> DataFrame:
    """``target`` and a crawl's statistics, see ``schemas.STATS``; a target without files is there if anything of it failed or was visited.

    ``files``: all of them, marked; ``visits``: what a crawl asked for; ``responses`` with ``target, status, is_js`` tell error statuses with a script's content.
    """
    own, kept = F.col("kind") == "file", ~F.coalesce("is_duplicate", F.lit(False))
    none = {"mode": "string", "is_duplicate": "boolean", "is_obfuscated": "boolean", "size": "long"}

    def tagged(frame: DataFrame, kind: str) -> DataFrame:
        return frame.select("target", F.lit(kind).alias("kind"), *[(F.col(c) if c in frame.columns and kind == "file" else F.lit(None)).cast(t).alias(c) for c, t in none.items()])

    rows = tagged(files, "file").unionByName(tagged(failed, FAILED)).unionByName(tagged(maps, "map_files"))
    if visits is not None:
        rows = rows.unionByName(tagged(visits, VISITED))
    if responses is not None:
        rows = rows.unionByName(tagged(responses.where((F.col("status") >= 400) & F.col("is_js")), FAKE))

    def kind(name: str) -> Column:
        return F.count_if(F.col("kind") == name).alias(name)

    return rows.groupBy("target").agg(
        F.count_if(own & kept).alias("total_files"), F.count_if(own & kept & (F.col("mode") == "static")).alias("static_files"),
        F.count_if(own & kept & (F.col("mode") == "dynamic")).alias("dynamic_files"), kind("map_files"), kind(FAILED),
        F.count_if(own & kept & F.col("is_obfuscated")).alias("deobfuscated_files"), kind(VISITED), kind(FAKE), F.coalesce(F.sum(F.when(own & kept, F.col("size"))), F.lit(0)).alias("total_size"),
    )


def _entries(rows: DataFrame, order: list[str], entry: Column, to: str) -> DataFrame:
    """``target, part`` and an array of at most ``PART_ENTRIES`` entries."""
    numbered = running(rows.select("target", *[F.col(c).alias(f"_o{n}") for n, c in enumerate(order)], entry.alias("entry")), ["target"], [f"_o{n}" for n in range(len(order))], "n")
    each = numbered.select("target", (F.floor(F.col("n") / PART_ENTRIES)).cast("int").alias("part"), F.struct("n", "entry").alias("e"))
    return each.groupBy("target", "part").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["entry"]).alias(to))


def crawl_reports(
    files: DataFrame, failed: DataFrame, stats: DataFrame, config: CrawlConfig, out_dir: str, started: datetime | None = None, ended: datetime | None = None
) -> DataFrame:
    """``part`` and a report by ``schemas.REPORT`` for each target: task, times, statistics, configuration, directories, and entries by URL.

    A report has as many parts as it needs for ``PART_ENTRIES`` entries of each kind in one; statistics are in all parts, so each can be read by itself.
    ``files``: see ``assets.with_paths``; duplicates have no entries; ``stats``: see :func:`statistics`.
    """
    info = F.struct("url", "file_path", "size", "hash", F.col("mode").alias("crawl_mode"), (F.col("fetched_at") if "fetched_at" in files.columns else F.lit(None).cast("timestamp")).alias("downloaded_at"))
    good = _entries(files.where(~F.coalesce("is_duplicate", F.lit(False))) if "is_duplicate" in files.columns else files, ["url", "mode", "seq"], info, "good")
    bad = _entries(failed, ["url"], F.struct("url", "error_type", "error_msg", "retries"), "bad")
    parts = stats.select("target", F.lit(0).alias("part")).union(good.select("target", "part")).union(bad.select("target", "part")).distinct()

    def joined(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
        names = {k: f"_{k}" for k in keys}
        same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
        return left.join(right.withColumnsRenamed(names), same[0] if len(same) == 1 else same[0] & same[1], "left").drop(*names.values())

    out = joined(joined(joined(parts, good, "target", "part"), bad, "target", "part"), stats, "target")
    seconds = (ended - started).total_seconds() if started and ended else None
    given = asdict(config)
    known = {k: given[k] for k in (x.split(": ")[0] for x in schemas.CONFIG.split(", "))}
    at = F.concat_ws("/", F.lit(out_dir), F.col("target"))
    counts = F.struct(*[(F.col(c) if c in stats.columns else F.lit(seconds if c == "duration" else None).cast(t)).alias(c) for c, t in (x.split(": ") for x in schemas.STATS.split(", "))])
    none = F.array()
    return out.select(
        "part", stable_id("target").alias("task_id"), F.col("target").alias("target_url"), F.when(host(F.col("target")) == "", F.col("target")).otherwise(host(F.col("target"))).alias("domain"),
        F.lit(config.mode).alias("mode"), F.lit(started).alias("start_time"), F.lit(ended).alias("end_time"), F.lit(seconds).alias("duration"), counts.alias("stats"),
        F.coalesce("good", none).alias("success_files"), F.coalesce("bad", none).alias("failed_files"),
        at.alias("output_dir"), F.concat_ws("/", at, F.lit("encode")).alias("encode_dir"), F.concat_ws("/", at, F.lit("decode")).alias("decode_dir"), F.struct(*[F.lit(v).alias(k) for k, v in known.items()]).alias("config"),
    )


def run(responses: DataFrame, out_dir: str, config: CrawlConfig | None = None) -> None:
    """The dataflow with its writers: bodies, maps, cleaned code and reports under ``out_dir``.

    Files are unpacked and marked once and kept as a table in the shared folder, which is removed at the end.  Reports are JSON lines, a folder for
    each target: ``crawl_report`` (see :func:`crawl_reports`), ``success_files``, ``failed_files``, ``js_files``.
    """
    spark, out, started = responses.sparkSession, out_dir.rstrip("/"), datetime.now(UTC)
    with stored(script_files(responses).drop("body")) as files:
        body = with_paths(files, out_dir).withColumnRenamed("plain", "body").drop("code", "decode_error")
        body.write.mode("overwrite").partitionBy("target").parquet(f"{out}/encode/js")
        kept = spark.read.schema(body.schema).parquet(f"{out}/encode/js")
        maps = source_map_files(files, responses, out_dir)
        maps.write.mode("overwrite").partitionBy("target").parquet(f"{out}/encode/map")
        maps = spark.read.schema(maps.schema).parquet(f"{out}/encode/map")
        code = kept.withColumn("code", F.try_validate_utf8(F.col("body").cast("string")))
        cleaned_files(code, out_dir).write.mode("overwrite").partitionBy("target").parquet(f"{out}/decode/js")
        failed = failed_files(responses)
        report = crawl_reports(kept, failed, statistics(files, failed, maps), config or CrawlConfig(), out_dir, started, datetime.now(UTC))
        for name, frame in (
            ("crawl_report", report.withColumn("target", F.col("target_url"))), ("success_files", success_files(kept)), ("failed_files", failed),
            ("js_files", js_files(kept, maps, ("target",))),
        ):
            frame.write.mode("overwrite").partitionBy("target").json(f"{out}/reports/{name}")
