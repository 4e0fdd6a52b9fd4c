"""Command line: responses to script files, cleaned code and reports."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from silkmill.functions import headers
from silkmill.operators.crawl import Rules, replay
from silkmill.plans import reports
from silkmill.session import session
from silkmill.sources import config
from silkmill.sources.responses import read_responses
from silkmill.sources.url_list import read_url_list


VERSION = "0.3"


def parser() -> argparse.ArgumentParser:
    """Options; those of the crawl without a default leave the configuration's value."""
    p = argparse.ArgumentParser(prog="silkmill", description=__doc__)
    p.add_argument("responses", help="table of captured responses")
    p.add_argument("-o", "--output", help="output folder")
    p.add_argument("-c", "--config", help="configuration file")
    p.add_argument("-u", "--url", help="only responses of this target")
    p.add_argument("-f", "--url-file", help="only responses of the targets in this list")
    p.add_argument("-H", "--header", action="append", default=[], help="'Name: Value', may be repeated; checked")
    p.add_argument("--replay", action="store_true", help="only responses that a crawl of the targets asks for; its state stays in the output folder, where --resume finds it")
    p.add_argument("--log-level", choices=("trace", "debug", "info", "warning", "error"), help="in the console and in the log folder's files")
    p.add_argument("--version", action="version", version=f"silkmill {VERSION}")
    p.add_argument("--validate-config", action="store_true", help="check the configuration and stop")
    for flag, name, kind in (
        (("-d", "--depth"), "depth", int), (("-w", "--wait"), "wait_time", int), (("-m", "--mode"), "mode", str), (("--threads",), "max_workers", int),
        (("--tabs",), "playwright_tabs", int), (("--similarity-threshold",), "similarity_threshold", float), (("--batch-delay",), "batch_delay", int),
    ):
        p.add_argument(*flag, dest=name, type=kind)
    for flag, name in (("--headless", "headless"), ("--resume", "resume"), ("--similarity", "similarity_enabled"), ("--continue-on-error", "continue_on_error")):
        p.add_argument(flag, dest=name, action=argparse.BooleanOptionalAction)
    return p


def header_errors(spark: SparkSession, lines: list[str]) -> list[str]:
    """What is wrong with header lines."""
    rows = spark.createDataFrame([(x,) for x in lines], "line string").select("line", headers.parsed(F.col("line")).alias("h"))
    text = F.coalesce(F.col("h.error"), headers.problem_text(F.col("h.name"), F.col("h.value")))
    return [f"{r.line!r}: {r.text}" for r in rows.select("line", text.alias("text")).where("text IS NOT NULL").collect()]


def main(args: list[str] | None = None) -> None:
    given = parser().parse_args(args)
    settings = config.load_all(given.config, vars(given))
    if given.validate_config:
        print(settings)
        return
    if not given.url and not given.url_file:
        parser().error("--url or --url-file is needed")
    logging_ = replace(settings.logging, **({"level": given.log_level} if given.log_level else {}))
    log = config.log_to(logging_)
    log.info("responses of %s, mode %s, depth %d", given.url or given.url_file, settings.crawl.mode, settings.crawl.depth)
    spark = session()
    if given.header and (wrong := header_errors(spark, given.header)):
        parser().error("; ".join(wrong))
    out = given.output or settings.output.base_dir
    responses = read_responses(spark, given.responses)
    if settings.crawl.mode != "all":
        responses = responses.where(responses.mode == settings.crawl.mode)
    if given.url:
        targets = spark.createDataFrame([(given.url,)], "target_url string")
    else:
        targets = read_url_list(spark, given.url_file).select("url").distinct().withColumnRenamed("url", "target_url")
    responses = responses.join(targets, "target_url", "left_semi")
    if given.replay or settings.crawl.resume:
        seeds = targets.select(F.col("target_url").alias("target"), F.col("target_url").alias("url"))
        for mode in ("static", "dynamic") if settings.crawl.mode == "all" else (settings.crawl.mode,):
            rules = Rules(settings.crawl.depth, mode, settings.crawl.allow_cross_domain)
            asked = replay(responses, seeds, rules, f"{out}/state/{mode}", settings.crawl.resume).select(F.col("target").alias("target_url"), "url", F.lit(mode).alias("mode"))
            responses = responses.where(responses.mode != mode).unionByName(responses.where(responses.mode == mode).join(asked, ["target_url", "url", "mode"], "left_semi").select(responses.columns))
    reports.run(responses, out, settings.crawl)
    log.info("files and reports are in %s", out)


if __name__ == "__main__":
    main()
