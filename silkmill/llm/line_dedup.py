"""Line dedup by pairwise alignment.

The result is that of a patience diff of every document with every earlier one that shares a
line of at least ``MIN_WORDS`` words: of the aligned common blocks those with such a line are
deleted from the later document.  Most of these pairs need not be formed:

1. What a document does to another depends only on its shared lines and on where others stand
   between them (its form).  From all but the earliest document of a form goes everything that
   any other could take: the whole runs of shared lines with a long one.
2. The earliest ones are aligned with the earliest holder of the rarest long line of each run of shared lines.
3. What then stays and might still be taken asks for further holders of its key, in rounds: a
   hash deals a key's holders to rounds of about four times the holders each, so the last round
   has all of them.  A key is a long line, or two lines in a row for the short lines beside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silkmill.llm.common import as_doc, materialise
from silkmill.llm.patience import common_blocks
from silkmill.llm.text import WORD_PATTERN

#: Words of a long line; two characters of a script without spaces count as one.
MIN_WORDS = 5
#: Thai and Lao, Burmese, Khmer, Chinese and Japanese; and one quick range around them all.
UNSPACED = r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\u9FFF\uF900-\uFAFF\uFF66-\uFF9F\x{20000}-\x{3FFFF}]"
UNSPACED_AROUND = r"[\u0E00-\x{3FFFF}]"
NO_ID = (1 << 63) - 1
#: A lead, a form's earliest document: how many lines, places of the shared ones, these, and each one's earliest holder;
#: ``rare`` (in its table alone): those of the rarest lines.
LEAD = "o long, h long, size int, at array<int>, line array<long>, long array<boolean>, first array<long>"


def _runs(at: list[int], long_: list[bool]) -> list[tuple[int, int]]:
    """Runs of places in a row with a long line, as begin and end in ``at``."""
    cuts = [0, *(k for k in range(1, len(at)) if at[k] != at[k - 1] + 1), len(at)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if any(long_[a:b])]


def _keys(line: list[int], begin: int, end: int) -> list[int]:
    """Keys of each two lines in a row."""
    two = np.array([line[begin : end - 1], line[begin + 1 : end]], np.int64).T
    return [xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63) for x in two]


def _reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents less the lines that no other has; ``whole``: places of their runs with a long line, ``rare``: see ``LEAD``."""
    for pdf in batches:
        rows = []
        for o, h, lines, long_, shared in zip(pdf["o"], pdf["h"], pdf["lines"], pdf["long"], pdf["shared"], strict=True):
            first = {x["line"]: x["first"] for x in shared}
            held = {x["line"]: x["held"] for x in shared}
            at = [k for k, x in enumerate(lines.tolist()) if x in first]
            line, marks = lines[at].tolist(), long_[at].tolist()
            runs = _runs(at, marks)
            if not runs:
                continue
            gaps = np.diff(np.array([-1, *at, len(lines)])) > 1
            form = xxhash.xxh128_digest(np.array(line, np.int64).tobytes() + gaps.tobytes())
            whole = [at[k] for a, b in runs for k in range(a, b)]
            rare = {first[min((x for x, m in zip(line[a:b], marks[a:b], strict=True) if m), key=held.get)] for a, b in runs}
            rows.append((o, h, len(lines), form, at, line, marks, [first[x] for x in line], whole, list(rare)))
        yield pd.DataFrame(rows, columns=["o", "h", "size", "form", "at", "line", "long", "first", "whole", "rare"])


def _apart(at: list[int], line: list[int], size: int, gap: str) -> list:
    """The lines, with a mark wherever others stand between."""
    out: list = []
    for k, x in enumerate(line):
        if at[k] != (at[k - 1] + 1 if k else 0):
            out.append(gap)
        out.append(x)
    return out if at[-1] == size - 1 else [*out, gap]


def _aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Places of the later document in common blocks that hold a long line."""
    for pdf in batches:
        rows = []
        for o, h, size, at, line, long_, early_size, early_at, early in zip(
            *(pdf[c] for c in ("o", "h", "size", "at", "line", "long", "early_size", "early_at", "early")), strict=True
        ):
            at, line = at.tolist(), line.tolist()
            late, places = _apart(at, line, size, "late"), iter(zip(at, long_.tolist(), strict=True))
            spots = [None if x == "late" else next(places) for x in late]
            gone: list[int] = []
            for _, j, n in common_blocks(_apart(early_at.tolist(), early.tolist(), early_size, "early"), late):
                if any(spots[k][1] for k in range(j, j + n)):
                    gone += [spots[k][0] for k in range(j, j + n)]
            if gone:
                rows.append((o, h, gone))
        yield pd.DataFrame(rows, columns=["o", "h", "gone"])


def _offered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A lead's keys as a holder."""
    for pdf in batches:
        rows = []
        for o, h, at, line, long_ in zip(pdf["o"], pdf["h"], pdf["at"], pdf["line"], pdf["long"], strict=True):
            keys = set(line[long_].tolist())
            for a, b in _runs(at.tolist(), long_.tolist()):
                keys.update(_keys(line.tolist(), a, b))
            rows.append((o, h, list(keys)))
        yield pd.DataFrame(rows, columns=["o", "h", "keys"])


def _asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A lead's keys as a later document: those of lines that stay though an earlier document has them."""
    for pdf in batches:
        rows = []
        for o, h, size, at, line, long_, first, gone in zip(
            *(pdf[c] for c in ("o", "h", "size", "at", "line", "long", "first", "gone")), strict=True
        ):
            taken, keys = set(gone.tolist()), set()
            for a, b in _runs(at.tolist(), long_.tolist()):
                twos = _keys(line.tolist(), a, b)
                for k in range(a, b):
                    if at[k] in taken or first[k] >= o:
                        continue
                    if long_[k]:
                        keys.add(int(line[k]))
                    else:
                        keys.update(twos[max(k - a - 1, 0) : k - a + 1])
            if keys:
                rows.append((o, h, size, at, line, long_, first, gone, list(keys)))
        yield pd.DataFrame(rows, columns=["o", "h", "size", "at", "line", "long", "first", "gone", "keys"])


def _join_gone(parts: DataFrame) -> DataFrame:
    return parts.groupBy("o", "h").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


def _align(late: DataFrame, pairs: DataFrame, early: DataFrame, on: list[str]) -> DataFrame:
    """``o, h, gone`` of ``late`` from ``pairs``: ``o, h`` and the columns ``on`` of ``early``."""
    met = pairs.join(early, on).join(late.select("o", "h", "size", "at", "line", "long"), ["o", "h"])
    return met.mapInPandas(_aligned, "o long, h long, gone array<int>")


def _leads_removed(leads: DataFrame) -> DataFrame:
    """``o, h, gone`` for the earliest documents of all forms."""
    early = leads.select(
        F.col("o").alias("eo"), F.col("h").alias("eh"), F.col("size").alias("early_size"), F.col("at").alias("early_at"), F.col("line").alias("early")
    )
    pairs = leads.select("o", "h", F.explode("rare").alias("eo")).where("eo < o")
    star = materialise(_join_gone(_align(leads, pairs, early, ["eo"])))
    none = F.array().cast("array<int>")
    act = leads.join(star, ["o", "h"], "left").withColumn("gone", F.coalesce("gone", none))
    asking = f"{LEAD}, gone array<int>, keys array<long>"
    act = materialise(act.mapInPandas(_asked, asking))
    holders = leads.mapInPandas(_offered, "o long, h long, keys array<long>").select(
        F.col("o").alias("eo"), F.col("h").alias("eh"), F.explode("keys").alias("key")
    )
    holders = holders.join(act.select(F.explode("keys").alias("key")).distinct(), "key", "left_semi")
    # Of a key's holders one in 4^n has level n or more; those of the highest levels come first.
    spot = F.xxhash64(F.lit("round"), "eo", "eh").bitwiseAND(F.lit((1 << 62) - 1))
    level = F.floor(F.bit_count(spot.bitwiseAND(-spot) - 1) / 2)
    rounds = holders.groupBy("key").agg(F.ceil(F.log2(F.count(F.lit(1)).cast("double")) / 2).alias("rounds"))
    due = F.greatest(F.col("rounds") - level, F.lit(0)).cast("int").alias("due")
    holders = materialise(holders.join(rounds, "key").select("key", "eo", "eh", due))
    last = holders.agg(F.max("due")).first()[0]
    gone = [star]
    for turn in range(-1 if last is None else last + 1):
        asked = act.select("o", "h", F.explode("keys").alias("key")).join(holders.where(F.col("due") == turn).drop("due"), "key")
        pairs = asked.where("eo < o").select("o", "h", "eo", "eh").distinct()
        more = materialise(_join_gone(_align(act, pairs, early, ["eo", "eh"])))
        gone.append(more)
        act = act.drop("keys").join(more.withColumnRenamed("gone", "more"), ["o", "h"], "left")
        act = act.withColumn("gone", F.array_union("gone", F.coalesce("more", none))).drop("more")
        act = materialise(act.mapInPandas(_asked, asking))
        if act.isEmpty():
            break
    out = gone[0]
    for x in gone[1:]:
        out = out.union(x)
    return _join_gone(out)


def removed_lines(docs: DataFrame) -> DataFrame:
    """``o, h, gone``: numbers of deleted lines per document; ``docs``: ``o, h, text``."""
    lines = F.split("text", "\n")

    def words(x: Column) -> Column:
        return F.regexp_count(x, F.lit(WORD_PATTERN))

    def signs(x: Column) -> Column:
        return F.floor(F.regexp_count(x, F.lit(UNSPACED)) / 2)

    # Asked once for a text, not for each line.
    long_ = F.when(F.col("text").rlike(UNSPACED_AROUND), F.transform(lines, lambda x: words(x) + signs(x) >= MIN_WORDS))
    long_ = long_.otherwise(F.transform(lines, lambda x: words(x) >= MIN_WORDS))
    d = docs.select("o", "h", F.transform(lines, lambda x: F.xxhash64(x)).alias("lines"), long_.alias("long"))
    d = materialise(d.dropDuplicates(["o", "h"]))
    held = d.select("o", "h", F.explode(F.array_distinct("lines")).alias("line"))
    first = held.groupBy("line").agg(F.min("o").alias("first"), F.max("o").alias("last"), F.count(F.lit(1)).alias("held"))
    first = first.where("first < last").drop("last")
    shared = held.join(first, "line").groupBy("o", "h").agg(F.collect_list(F.struct("line", "first", "held")).alias("shared"))
    reduced = d.join(shared, ["o", "h"]).mapInPandas(_reduced, f"{LEAD}, form binary, whole array<int>, rare array<long>")
    reduced = materialise(reduced)
    lead = reduced.groupBy("form").agg(F.min("o").alias("lead"))
    known = reduced.join(lead, "form")
    leads = materialise(known.where("o = lead").select("o", "h", "size", "at", "line", "long", "first", "rare"))
    later = known.where("o > lead").select("o", "h", F.col("whole").alias("gone"))
    return later.union(_leads_removed(leads))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the text less its deleted lines, plus ``_n_lines`` and ``_n_removed``.

    Null texts stay null, empty ones have one empty line.  A document is later than another if
    its doc_id is larger; null ids are the largest.  Rows with the same id are never compared, so
    repeated rows are treated alike.  Lines of fewer words are only deleted inside a block
    with a longer one.  A document whose lines all go keeps an empty text.  ``n_chars``, if there,
    follows the text.
    """
    rows = docs.select(
        as_doc(docs), F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("o"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text")
    )
    gone = removed_lines(rows.where(F.col("text").isNotNull()).select("o", "h", "text"))
    out = rows.join(gone, ["o", "h"], "left")
    lines = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    left = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    out = out.withColumn("new", F.when(F.col("gone").isNull(), F.col("text")).otherwise(left))
    old = F.col("doc")
    columns = [
        F.col("new").alias(c) if c == text
        else F.when(F.col("gone").isNull(), old.getField(c)).otherwise(F.char_length("new").cast("long")).alias(c) if c == "n_chars"
        else old.getField(c).alias(c)
        for c in docs.columns
        if c not in ("_n_lines", "_n_removed")
    ]
    return out.select(
        *columns, F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("_n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("_n_removed"),
    )
