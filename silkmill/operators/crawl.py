"""Replay of a crawl over captured responses: from seeds to visits and files, level by level, with a state that can be resumed.

A level is the URLs that are asked for at one depth, numbered in the order of a first-in first-out queue.  Of its URLs those
with an HTML response are read, and only their links are extracted; links pass the gates, and what no level has yet is the next
level.  Every level is a table of the state's folder.  A level counts once its mark is there, which is
written last and put in place by renaming, so a run that stops, or a task that runs again, leaves no half level.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from silkmill.functions.urls import host, is_javascript, scheme
from silkmill.operators.dedupe import first_by_url
from silkmill.operators.extract import links
from silkmill.operators.ordinal import running
from silkmill.plans.assets import failure, script_files
from silkmill.session import shared_folder

VISITS = "target string, url string, depth int, kind string, found boolean, place long"
#: A crawl whose scripts name each other without end is given up.
MAX_LEVELS = 1000


@dataclass(frozen=True)
class Rules:
    """What a crawl follows.  ``mode`` chooses the responses and the rules: ``static`` counts the entry as level 1, ``dynamic`` as level 0.

    A page below ``depth`` gives links; scripts are asked for whatever their depth.  Without ``cross_domain`` links, and in static mode
    scripts too, must be on the seed's host; in dynamic mode links must then be on their page's host as well.
    """

    depth: int = 2
    mode: str = "static"
    cross_domain: bool = True

    @property
    def start(self) -> int:
        return 1 if self.mode == "static" else 0


class State:
    """The levels in a folder: tables, and a mark for each that is whole."""

    def __init__(self, spark: SparkSession, folder: str, rules: Rules):
        self.spark, self.folder, self.rules = spark, folder.rstrip("/"), rules
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def table(self, level: int) -> str:
        return f"{self.folder}/level={level:04d}"

    def _mark(self, level: int):
        return self._path(f"{self.folder}/whole-{level:04d}.json")

    def known(self, level: int) -> dict | None:
        """What the mark of a level says, or nothing."""
        if not self.fs.exists(self._mark(level)):
            return None
        stream = self.fs.open(self._mark(level))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write(self, level: int, visits: DataFrame) -> int:
        """Writes a level that is not whole and marks it; its number of rows."""
        if self.fs.exists(self._mark(level)):
            raise FileExistsError(f"level {level} of {self.folder} is whole")
        visits.select(*[f.split()[0] for f in VISITS.split(", ")]).write.mode("overwrite").parquet(self.table(level))
        rows = self.read(level).count()
        draft = self._path(f"{self.folder}/draft-{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(json.dumps({"level": level, "rows": rows, "rules": asdict(self.rules)}).encode()))
        stream.close()
        if not self.fs.rename(draft, self._mark(level)):
            raise FileExistsError(f"level {level} of {self.folder} is being written by another run")
        return rows

    def read(self, *levels: int) -> DataFrame:
        return self.spark.read.schema(VISITS).parquet(*map(self.table, levels))

    def whole(self) -> int:
        """How many levels are whole; an error if they were made by other rules."""
        for level in range(MAX_LEVELS):
            mark = self.known(level)
            if mark is None:
                return level
            if mark["rules"] != asdict(self.rules):
                raise ValueError(f"{self.folder} holds a crawl by other rules: {mark['rules']}")
        return MAX_LEVELS

    def clear(self) -> None:
        self.fs.delete(self._path(self.folder), True)


def _of_level(responses: DataFrame, level: DataFrame, rules: Rules, *columns: str) -> DataFrame:
    """``_t, _u`` and ``columns`` of the responses to a level's URLs."""
    have = responses.where(F.col("mode") == rules.mode).select(F.col("target_url").alias("_t"), F.col("url").alias("_u"), *columns)
    return have.join(level.select("target", "url"), F.col("_t").eqNullSafe(F.col("target")) & (F.col("_u") == F.col("url")), "left_semi")


def _asked(responses: DataFrame, level: DataFrame, rules: Rules) -> DataFrame:
    """The level's URLs with their responses, the first one of each."""
    met = _of_level(responses, level, rules, "mode", "seq", "status", "content_type", "body")
    return level.join(first_by_url(met, ("_t", "_u")), F.col("target").eqNullSafe(F.col("_t")) & (F.col("url") == F.col("_u")))


def _with_found(responses: DataFrame, level: DataFrame, rules: Rules) -> DataFrame:
    """The level with ``found``; reads no bodies."""
    have = _of_level(responses, level, rules).distinct()
    out = level.join(have, F.col("target").eqNullSafe(F.col("_t")) & (F.col("url") == F.col("_u")), "left")
    return out.withColumn("found", F.col("_u").isNotNull())


def _is_page(status: Column, content_type: Column) -> Column:
    """A response whose links count: HTML that was answered with success."""
    return status.between(200, 202) & F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("html"))


def _next(pages: DataFrame, entry: DataFrame, known: DataFrame, depth: int, rules: Rules) -> DataFrame:
    """``target, url, kind, from, pos`` of the URLs that the next level asks for."""
    html = pages.where(_is_page(F.col("status"), F.col("content_type"))).select("target", "place", "url", F.try_validate_utf8(F.col("body").cast("string")).alias("html"))
    found = links(html, ("target", "place"), "url", "html").withColumn("link", F.regexp_replace("link", r"#.*\z", ""))
    found = found.where(scheme(F.col("link")).isin("http", "https") & ~F.startswith("href", F.lit("#")))
    script = (F.col("tag") == "script") & is_javascript(F.col("link"))
    follow = F.lit(depth < rules.depth) & (F.col("tag") == "a" if rules.mode == "static" else F.lit(True))
    if not rules.cross_domain:
        found = found.join(entry, F.col("target").eqNullSafe(F.col("_t")))
        on_host = host(F.col("link")) == F.col("_host")
        follow = follow & on_host & (F.lit(True) if rules.mode == "static" else host(F.col("link")) == host(F.col("url")))
        script = script & on_host if rules.mode == "static" else script
    found = found.withColumn("kind", F.when(follow, "page").when(script, "script")).where("kind IS NOT NULL")
    each = found.groupBy("target", F.col("link").alias("url")).agg(F.min("kind").alias("kind"), F.min(F.struct("place", "pos")).alias("at"))
    seen = known.select(F.col("target").alias("_t"), F.col("url").alias("_u"))
    new = each.join(seen, F.col("target").eqNullSafe(F.col("_t")) & (F.col("url") == F.col("_u")), "left_anti")
    return new.select("target", "url", "kind", F.col("at.place").alias("from"), F.col("at.pos").alias("pos"))


def replay(responses: DataFrame, seeds: DataFrame, rules: Rules | None = None, folder: str | None = None, resume: bool = False, stop_after: int | None = None) -> DataFrame:
    """``target, url, depth, kind, found, place``: every URL that a crawl from ``seeds`` (``target, url``) asks for, once.

    ``responses``: see ``schemas.RESPONSES``; ``kind``: page or script; ``found``: there is a response; ``place``: the URL's number within its target and
    depth, by the number of the page that names it first, then by its place there, anchors before scripts.  A seed that is repeated
    counts once; seeds of a target are numbered by URL.  Fragments are dropped.

    ``folder``: where the state stays; without one it is in the shared folder.  ``resume`` goes on after the last whole level of the
    folder, and is an error if that was made by other rules; else what the folder holds is dropped.  ``stop_after`` ends
    after so many levels, as a run that is broken off would.
    """
    spark, rules = responses.sparkSession, rules or Rules()
    state = State(spark, folder or f"{shared_folder(spark).rstrip('/')}/crawl-{uuid.uuid4().hex}", rules)
    level = state.whole() if resume else 0
    if not level:
        state.clear()
    rows = state.known(level - 1)["rows"] if level else 1
    entries = seeds.select(F.col("target").cast("string").alias("target"), F.regexp_replace("url", r"#.*\z", "").alias("url")).distinct()
    entry = entries.groupBy(F.col("target").alias("_t")).agg(F.min(host(F.col("url"))).alias("_host"))
    while rows and level < (MAX_LEVELS if stop_after is None else stop_after):
        depth = rules.start + level
        if level:
            before = state.read(level - 1).where("found")
            new = _next(_asked(responses, before, rules), entry, state.read(*range(level)), depth - 1, rules)
            new = running(new, ["target"], ["from", "pos", "url"], "place")
        else:
            new = running(entries.withColumn("kind", F.lit("page")), ["target"], ["url"], "place")
        new = new.select("target", "url", F.lit(depth).alias("depth"), "kind", "place")
        rows = state.write(level, _with_found(responses, new, rules))
        level += 1
    return state.read(*range(max(level, 1)))


def visit_order(visits: DataFrame) -> DataFrame:
    """Adds ``ordinal``: a visit's number within its target, as a first-in first-out queue hands them out.

    Places within a depth are known; what is added is the number of visits of lesser depths, a sum over one row per target and depth.
    """
    earlier = W.partitionBy("target").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    sizes = visits.groupBy("target", "depth").agg(F.count(F.lit(1)).alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    sizes = sizes.select(F.col("target").alias("_t"), F.col("depth").alias("_d"), "_before")
    out = visits.join(sizes, F.col("target").eqNullSafe(F.col("_t")) & (F.col("depth") == F.col("_d")))
    return out.withColumn("ordinal", F.col("_before") + F.col("place")).drop("_t", "_d", "_before")


def crawled_files(responses: DataFrame, visits: DataFrame, mode: str = "static") -> DataFrame:
    """The script files (see :func:`silkmill.plans.assets.script_files`) among the responses that a crawl asked for, with its ``depth``."""
    asked = visits.where("found").select(F.col("target").alias("_t"), F.col("url").alias("_u"), F.col("depth").alias("_depth"))
    own = responses.where(F.col("mode") == mode)
    met = own.join(asked, F.col("target_url").eqNullSafe(F.col("_t")) & (F.col("url") == F.col("_u"))).withColumn("depth", F.col("_depth"))
    return script_files(met.drop("_t", "_u", "_depth"))



def failed_requests(responses: DataFrame, visits: DataFrame, mode: str = "static") -> DataFrame:
    """``target, url, error_type, error_msg, retries``: asked for in vain: no response, or a page's response without success.

    What a script's response holds is judged by its content, whatever its status: :func:`silkmill.plans.assets.failed_files`.
    """
    own = responses.where((F.col("mode") == mode) & ~is_javascript(F.col("url"))).select(F.col("target_url").alias("_t"), F.col("url").alias("_u"), "mode", "seq", "status")
    bad = first_by_url(own, ("_t", "_u")).where(~F.coalesce(F.col("status").between(200, 202), F.lit(False)))
    met = visits.join(bad, F.col("target").eqNullSafe(F.col("_t")) & (F.col("url") == F.col("_u")), "left")
    return met.where(~F.col("found") | F.col("_u").isNotNull()).select("target", "url", *failure())
