"""Local file paths of downloaded files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from silkmill.functions.urls import host, path
from silkmill.operators.dedupe import mode_rank
from silkmill.operators.ordinal import running
from silkmill.session import shared_folder


def file_name(url: Column) -> Column:
    """Last part of the URL's path; ``index.js`` for an empty path, ``/`` for the root."""
    p = F.regexp_replace(path(url), r"/+\z", "")
    base = F.regexp_extract(p, r"([^/]*)\z", 1)
    return F.when(path(url) == "", "index.js").when(p == "", "/").when(base == ".", "index.js").otherwise(base)


def source_host(url: Column) -> Column:
    return F.when(host(url) == "", "unknown").otherwise(host(url))


def with_number(name: Column, number: Column) -> Column:
    """``base_N.ext`` for N > 0."""
    ext = F.regexp_extract(name, r"(\.[^./]*)\z", 1)
    base = F.left(name, F.length(name) - F.length(ext))
    return F.when(number == 0, name).otherwise(F.concat(base, F.lit("_"), number.cast("string"), ext))


def numbered_paths(files: DataFrame, out_dir: str, subdir: str, target: str = "target", url: str = "url", seq: str = "seq") -> DataFrame:
    """Adds ``file_path``; the n-th file of a name and host gets the number n.

    No Python, but exact only if no file is by nature called like another one's numbered name; see :func:`greedy_paths`.
    """
    files = files.withColumn("_name", file_name(F.col(url))).withColumn("_host", source_host(F.col(url)))
    number = F.row_number().over(W.partitionBy(target, "_host", "_name").orderBy(seq)) - 1
    name = F.when(F.col("_name") == "/", "").otherwise(with_number(F.col("_name"), number))
    joined = F.concat_ws("/", F.lit(out_dir), F.col(target), F.lit(subdir), F.col("_host"), F.nullif(name, F.lit("")))
    return files.withColumn("file_path", joined).drop("_name", "_host")


#: A name that another one's numbering can make: what is before the number, the number, the extension.
NUMBERED = r"\A(.*)_([1-9][0-9]{0,8})(\.[^./]*|)\z"


def _settled(pdf: pd.DataFrame) -> pd.DataFrame:
    """For the names of one family: was the natural name taken by another's number, and which requests skip a number.

    ``c`` files have the name, ``k`` is its number as a child of ``parent``, and ``q`` of the parent's files come before the
    name's first one.  Parents come before children; children of one parent in order of their numbers.
    """
    count = dict(zip(pdf["n"], pdf["c"], strict=True))
    lost = dict.fromkeys(count, False)
    skipped: dict[str, list[int]] = {n: [] for n in count}
    met = pdf[pdf["parent"].notna()]
    met = met.assign(depth=met["n"].str.len()).sort_values(["depth", "k"])
    for n, parent, k, q in met[["n", "parent", "k", "q"]].itertuples(index=False):
        request = int(k) - len(skipped[parent])  # the parent's request that would take this number
        if request > count[parent] - 1 + lost[parent]:
            continue
        if request - lost[parent] >= q:
            skipped[parent].append(request)
        else:
            lost[n] = True
    out = pdf[["t", "h", "n"]].copy()
    out["lost"], out["skipped"] = [int(lost[n]) for n in pdf["n"]], [skipped[n] for n in pdf["n"]]
    return out


def greedy_paths(files: DataFrame, out_dir: str, subdir: str, target: str = "target", url: str = "url", seq: str = "seq", tie: tuple[str, ...] = ("mode",)) -> DataFrame:
    """``files`` with ``file_path`` by the exact rule: the first free number, in order of arrival.

    Static files arrive before dynamic ones, then ``seq`` counts, then the URL.  A file is known by target, URL, ``seq`` and
    those of the columns ``tie`` that there are; rows equal in these share a path.  Null targets are a target.

    A name's files are numbered by running sums.  Only where a file is by nature called like another one's number do
    names depend on each other: then a row for each such name, with the number of the other's files before it, is
    settled in order, and tells which numbers are skipped.  So no task sees all files of a name, but one sees the
    numbered names of a family (one base and extension in a host) in which some name occurs twice.
    """
    known = [target, url, seq, *[c for c in tie if c in files.columns]]
    shared_folder(files.sparkSession)
    rank = mode_rank(F.col("mode")) if "mode" in known else F.lit(0)
    name = file_name(F.col(url))
    rows = files.select(*known).distinct().select(
        F.struct(*known).alias("id"), F.struct(F.col(target).cast("string").alias("t"), source_host(F.col(url)).alias("h")).alias("at"),
        F.when(name == "/", "").otherwise(name).alias("n"), F.struct(rank.alias("r"), F.col(seq).alias("s"), F.col(url).alias("u"), F.struct(*known).alias("i")).alias("o"),
    ).checkpoint()
    names = rows.groupBy("at", "n").agg(F.count(F.lit(1)).alias("c"), F.min("o").alias("o"))
    names = names.withColumn("family", F.regexp_replace("n", r"(?:_[0-9]+)+(?=(?:\.[^.]*)?\z)", "")).checkpoint()
    met = names.groupBy("at", "family").agg(F.max("c").alias("most"), F.count(F.lit(1)).alias("kinds")).where("most > 1 AND kinds > 1")
    names = names.join(met.select("at", "family"), ["at", "family"], "left_semi")
    part = {x: F.regexp_extract("n", NUMBERED, n) for x, n in (("before", 1), ("k", 2), ("after", 3))}
    made = names.where(F.col("n").rlike(NUMBERED)).select("at", F.col("n").alias("child"), "o", F.concat(part["before"], part["after"]).alias("n"), part["k"].cast("long").alias("k"))
    made = made.join(names.select("at", "n"), ["at", "n"], "left_semi")
    none = F.lit(None)
    asked = made.select("at", "n", "o", none.cast(rows.schema["id"].dataType).alias("id"), "child", "k")
    counted = running(rows.select("at", "n", "o", "id", none.cast("string").alias("child"), none.cast("long").alias("k")).unionByName(asked), ["at", "n"], ["o"], "j", F.col("id").isNotNull().cast("long"))
    children = counted.where("child IS NOT NULL").select("at", F.col("child").alias("n"), F.col("n").alias("parent"), "k", F.col("j").alias("q"))
    families = names.join(children, ["at", "n"], "left").select("at.t", "at.h", "family", "n", "c", "parent", "k", "q")
    settled = families.groupBy("t", "h", "family").applyInPandas(_settled, "t string, h string, n string, lost long, skipped array<long>")
    settled = settled.select(F.struct("t", "h").alias("at"), "n", "lost", "skipped").checkpoint()
    files_ = counted.where("child IS NULL").join(settled, ["at", "n"], "left").withColumn("request", F.col("j") + F.coalesce("lost", F.lit(0)))
    more = F.coalesce(F.size(F.filter("skipped", lambda x: x <= F.col("request"))), F.lit(0))
    called = with_number(F.col("n"), F.when(F.col("request") == 0, F.lit(0).cast("long")).otherwise(F.col("request") + more))
    path_ = F.concat_ws("/", F.lit(out_dir), "at.t", F.lit(subdir), "at.h", F.nullif(called, F.lit("")))
    paths = files_.select(F.col("id").alias("_id"), path_.alias("file_path"))
    return files.withColumn("_own", F.struct(*known)).join(paths, F.col("_own") == F.col("_id")).drop("_own", "_id")


def _inflated(data: bytes, wbits: int) -> bytes:
    """One member after the other; what follows the last one must be zeros."""
    import zlib

    out = []
    while True:
        member = zlib.decompressobj(wbits)
        out.append(member.decompress(data) + member.flush())
        if not member.eof:
            raise zlib.error("cut off")
        data = member.unused_data
        if wbits < 0 or not data.strip(b"\0"):
            return b"".join(out)


def decompressed(
    rows: DataFrame, encoding: str = "content_encoding", body: str = "body", decoders: dict[str, Callable[[bytes], bytes]] | None = None
) -> DataFrame:
    """Adds ``plain`` and ``decode_error``: gzip (all members) and raw deflate undone; other encodings and broken bodies pass through.

    ``decoders``: functions from bytes to bytes for further encodings, such as ``{"br": brotli.decompress}``.
    """
    more = decoders or {}

    @F.pandas_udf("plain binary, decode_error string")
    def of(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for enc, data in parts:
            out = []
            for e, b in zip(enc, data, strict=True):
                kind = (e or "").strip().lower() if isinstance(e, str) or e is None else ""
                wbits = {"gzip": 31, "deflate": -15}.get(kind)
                if b is None or (wbits is None and kind not in more):
                    out.append((b, None if kind in ("", "gzip", "deflate", *more) else f"unsupported: {kind}"))
                    continue
                try:
                    out.append((_inflated(b, wbits) if wbits else more[kind](b), None))
                except Exception as error:  # whatever a decoder raises is the row's error
                    out.append((b, f"{kind}: {error}"))
            yield pd.DataFrame(out, columns=["plain", "decode_error"])

    return rows.withColumn("_d", of(F.col(encoding), F.col(body))).select("*", "_d.*").drop("_d")
