"""The crawl frontier: which links are followed, and breadth-first expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silkmill.functions.urls import host, scheme
from silkmill.session import shared_folder


def follow_reason(link: Column, depth: Column, visited: Column, max_depth: int, target_host: Column, cross_domain: bool = False) -> Column:
    """Why a link is not followed, in the order of the checks; null if it is."""
    out = F.when(~scheme(link).isin("http", "https"), "unsupported_scheme").when(visited, "visited")
    out = out.when(depth + 1 > max_depth, "too_deep")
    return out if cross_domain else out.when(host(link) != target_host, "cross_domain")


def follow_on_page(link: Column, page_url: Column, depth: Column, visited: Column, max_depth: int, target_host: Column) -> Column:
    """Like :func:`follow_reason` for a link found by a browser: it must be on its page's host, and on the target's."""
    return F.coalesce(
        follow_reason(link, depth, visited, max_depth, host(page_url)), F.when(host(link) != target_host, "cross_domain_of_target")
    )


def unvisited(links: DataFrame, visited: DataFrame, url: str = "url") -> DataFrame:
    """Links that are not in ``visited``."""
    return links.join(visited.select(url).distinct(), url, "left_anti")


def push(
    links: DataFrame, visited: DataFrame, max_depth: int, target_host: Column, cross_domain: bool = False, url: str = "url", depth: str = "depth"
) -> DataFrame:
    """Links that enter the queue: http(s), within the depth, on the host, not visited.

    The queue is a bag: a link that is pushed twice is in it twice.
    """
    ok = scheme(F.col(url)).isin("http", "https") & (F.col(depth) <= max_depth)
    ok = ok if cross_domain else ok & (host(F.col(url)) == target_host)
    return unvisited(links.where(ok), visited, url)


def expand(
    edges: DataFrame, seeds: DataFrame, max_depth: int, source: str = "src", to: str = "dst", node: str = "node", start_depth: int = 0
) -> DataFrame:
    """``node, depth``: what is reached from ``seeds`` in at most ``max_depth`` steps, with the least depth.

    Level by level: join, distinct, anti-join with what is known; every level is checkpointed in
    the shared folder.  ``start_depth`` 1 gives the rule that counts the entry as a level.
    Only the emptiness of a level is asked for on the driver.
    """
    shared_folder(edges.sparkSession)
    level = seeds.select(F.col(node).alias("node")).distinct().withColumn("depth", F.lit(start_depth)).checkpoint()
    known = level
    hops = edges.select(F.col(source).alias("node"), F.col(to).alias("next"))
    for depth in range(start_depth + 1, max_depth + 1):
        found = hops.join(level.select("node"), "node", "left_semi").select(F.col("next").alias("node")).distinct()
        level = found.join(known, "node", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if level.isEmpty():
            break
        known = known.unionByName(level)
    return known.withColumnRenamed("node", node)


def reached_scripts(pages: DataFrame, scripts: DataFrame, source: str = "src", to: str = "dst", node: str = "node") -> DataFrame:
    """``node, depth`` of the scripts that visited pages name, whatever their depth: scripts are exempt from the limit.

    ``pages``: see :func:`expand`; ``scripts``: edges from pages to scripts.  A script has one more than the least depth of
    its pages, and leads nowhere.
    """
    named = scripts.select(F.col(source).alias("_page"), F.col(to).alias("_script")).join(pages, F.col("_page") == F.col(node))
    return named.groupBy(F.col("_script").alias(node)).agg((F.min("depth") + 1).alias("depth"))


def visits(edges: DataFrame, seeds: DataFrame, max_depth: int, source: str = "src", to: str = "dst", node: str = "node") -> DataFrame:
    """``node, depth, visits``: the bag rule, in which every path to a node is a visit.

    Paths are counted, not listed: a level is a sum per node, and is checkpointed.
    """
    shared_folder(edges.sparkSession)
    level = seeds.groupBy(F.col(node).alias("node")).agg(F.count(F.lit(1)).alias("visits")).withColumn("depth", F.lit(0)).checkpoint()
    out = level
    hops = edges.select(F.col(source).alias("node"), F.col(to).alias("next"))
    for depth in range(1, max_depth + 1):
        level = hops.join(level, "node").groupBy("next").agg(F.sum("visits").alias("visits"))
        level = level.select(F.col("next").alias("node"), "visits", F.lit(depth).alias("depth")).checkpoint()
        out = out.unionByName(level)
    return out.withColumnRenamed("node", node)
