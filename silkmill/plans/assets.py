"""The whole dataflow: responses to script files, duplicates, obfuscation, cleaned code, report."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silkmill.functions.cleanup import cleaned, decode_path, source_map_reference
from silkmill.functions.detect import is_javascript_content, is_obfuscated
from silkmill.functions.urls import extension, is_javascript, resolve
from silkmill.operators.dedupe import content_hash, first_by_url, mark_duplicates
from silkmill.operators.graph import materialise
from silkmill.operators.paths import decompressed, greedy_paths
from silkmill.sources.responses import captured


def script_files(responses: DataFrame) -> DataFrame:
    """Script files of ``schemas.RESPONSES`` rows: unpacked, recognised, one per URL, duplicates marked.

    A static response needs a script's URL and valid content, a dynamic one is what a browser's capture keeps.
    Order: URL rule and content type (cheap) before the body's sample, URL before content hash.  Bodies are unpacked once: what
    passes the gates is checkpointed.
    """
    static = decompressed(responses.where((F.col("mode") == "static") & is_javascript(F.col("url"))))
    static = static.where(is_javascript_content(F.col("content_type"), F.col("plain")))
    dynamic = captured(responses.where(F.col("mode") == "dynamic")).withColumn("plain", F.col("body")).withColumn("decode_error", F.lit(None).cast("string"))
    found = static.unionByName(dynamic).withColumn("target", F.col("target_url"))
    found = materialise(found.withColumn("hash", content_hash(F.col("plain"))).withColumn("size", F.octet_length("plain").cast("long")))
    files = mark_duplicates(first_by_url(found)).withColumn("extension", extension(F.col("url")))
    files = files.withColumn("code", F.try_validate_utf8(F.col("plain").cast("string"))).withColumn("id", stable_id("target", "mode", "url"))
    return files.withColumn("is_obfuscated", F.coalesce(is_obfuscated(F.col("code")), F.lit(False)))


def failed_files(responses: DataFrame) -> DataFrame:
    """``target, url, error_type, error_msg, retries``: static script URLs whose content is no script, or that have no body."""
    static = decompressed(responses.where((F.col("mode") == "static") & is_javascript(F.col("url"))))
    bad = static.where(~F.coalesce(is_javascript_content(F.col("content_type"), F.col("plain")) & F.col("body").isNotNull(), F.lit(False)))
    return bad.select(F.col("target_url").alias("target"), "url", *failure())


def failure() -> list[Column]:
    # How a report names a failed download.
    return [F.lit("download_failed").alias("error_type"), F.lit("下载失败").alias("error_msg"), F.lit(0).alias("retries")]


def stable_id(*columns: str) -> Column:
    """A UUID's form made of a digest of columns: the same for the same file, so a task that is run again changes nothing."""
    hex_ = F.md5(F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    return F.regexp_replace(hex_, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def source_maps(files: DataFrame, responses: DataFrame) -> DataFrame:
    """Files that are no duplicates with the response of their source map, where one was captured."""
    asked = files.where(~F.col("is_duplicate")).withColumn("ref", source_map_reference(F.col("code"))).where("ref <> ''")
    asked = asked.select("target", "url", resolve(F.col("url"), F.col("ref")).alias("map_url"))
    found = responses.select(F.col("target_url").alias("_t"), F.col("url").alias("_u"), "mode", "seq", F.octet_length("body").cast("long").alias("map_size"))
    found = first_by_url(found, ("_t", "_u")).drop("mode", "seq")
    return asked.join(found, F.col("target").eqNullSafe(F.col("_t")) & (F.col("map_url") == F.col("_u")), "left").drop("_t", "_u")


def with_paths(files: DataFrame, out_dir: str = "output") -> DataFrame:
    """Files that are no duplicates, with the path of their body."""
    return greedy_paths(files.where(~F.col("is_duplicate")), out_dir, "encode/js")


def cleaned_files(files: DataFrame, out_dir: str = "output", deobfuscate: Callable[[str], str | None] | None = None) -> DataFrame:
    """Cleaned code and its path for obfuscated files that are no duplicates; ``files`` may have their paths already.

    ``deobfuscate``: an outside tool from code to code or null, for Python workers; where it gives null or fails, the
    own cleaning takes its place.
    """
    named = (files if "file_path" in files.columns else with_paths(files, out_dir)).where("is_obfuscated")
    code = cleaned(F.col("code"))
    if deobfuscate:
        code = F.coalesce(_outside(deobfuscate)(F.col("code")), code)
    return named.select("target", "mode", "url", "seq", "file_path", decode_path(F.col("file_path")).alias("decode_path"), code.alias("code"))


def _outside(deobfuscate: Callable[[str], str | None]) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def tried(code: str | None) -> str | None:
            try:
                return None if code is None else deobfuscate(code)
            except Exception:  # whatever the tool raises, the own cleaning follows
                return None

        for batch in batches:
            yield batch.map(tried).astype(object)

    return of


def source_map_files(files: DataFrame, responses: DataFrame, out_dir: str = "output") -> DataFrame:
    """Source maps that were captured with status 200, one per target and URL: body, size, hash, path and the script's URL."""
    asked = files.where(~F.col("is_duplicate") & (F.col("mode") == "static"))
    asked = asked.withColumn("ref", source_map_reference(F.col("code"))).where("ref IS NOT NULL")
    asked = asked.select("target", F.col("url").alias("js_file_url"), resolve(F.col("url"), F.col("ref")).alias("url"))
    asked = asked.groupBy(F.col("target").alias("_t"), F.col("url").alias("_u")).agg(F.min("js_file_url").alias("js_file_url"))
    found = responses.where("status = 200").select(F.col("target_url").alias("target"), "mode", "url", "seq", "body")
    found = found.join(asked, F.col("target").eqNullSafe(F.col("_t")) & (F.col("url") == F.col("_u"))).drop("_t", "_u")
    found = greedy_paths(first_by_url(found, ("target", "url")), out_dir, "encode/map")
    return found.withColumn("size", F.octet_length("body").cast("long")).withColumn("hash", content_hash(F.col("body")))


def success_files(files: DataFrame) -> DataFrame:
    """``target`` and a file's entry in the report, for files that are no duplicates."""
    return files.where(~F.col("is_duplicate")).select("target", "url", "size", "hash", F.col("mode").alias("crawl_mode"))


def report(files: DataFrame, failed: DataFrame | None = None, maps: DataFrame | None = None, visited: DataFrame | None = None) -> DataFrame:
    """One row per target: counts of files, duplicates, bytes, failures, maps and visited URLs.

    The entries themselves are rows of :func:`success_files` and :func:`failed_files`; no row holds all files of a target.
    """
    out = files.groupBy("target").agg(
        F.count(F.lit(1)).alias("files"), F.count_if("is_duplicate").alias("duplicates"), F.sum("size").alias("total_size"),
        F.count_if((F.col("mode") == "static") & ~F.col("is_duplicate")).alias("static_files"),
        F.count_if((F.col("mode") == "dynamic") & ~F.col("is_duplicate")).alias("dynamic_files"),
    )
    for name, more in (("failed_files", failed), ("map_files", maps), ("visited_urls", visited)):
        if more is None:
            out = out.withColumn(name, F.lit(0).cast("long"))
        else:
            counts = more.groupBy(F.col("target").alias("_t")).agg(F.count(F.lit(1)).alias(name))
            out = out.join(counts, F.col("target").eqNullSafe(F.col("_t")), "left").drop("_t").fillna(0, [name])
    return out
