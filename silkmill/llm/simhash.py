"""SimHash near-duplicates with a pigeonring candidate filter.

The 64 bits form a ring of five segments.  If two fingerprints differ in at most
``MAX_BITS`` = 4 bits, some segment starts a chain in which every prefix of l segments
differs in at most floor(4 l / 5) bits: 0, 1, 2, 3, 4.  The first three budgets make the
join key: the first segment agrees, and of the four parts of the next two segments at
least two agree, because at most two bits differ there.  That is 5 starts times 6 pairs
of parts, each key about 26 bits wide.  Candidates then have to pass the chain's own
budgets before the full Hamming distance is taken.

Rows that share a key are first tied to the key's least fingerprint (a star).  Only
fingerprints that are then still in different components are compared in pairs, so a
large group of near copies gives links in proportion to its members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silkmill.llm.common import as_doc, components, from_doc, hamming, materialise, small_batches
from silkmill.llm.simhash_fp import fingerprint
from silkmill.operators.graph import SHUFFLED

MAX_BITS = 4
#: (lowest bit, width) around the ring.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
BUDGETS = tuple(MAX_BITS * n // len(SEGMENTS) for n in range(1, len(SEGMENTS) + 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mask(low: int, width: int) -> int:
    return ((1 << width) - 1) << low


def key_masks() -> list[int]:
    """One bit mask per join key: a whole segment and two parts of the two that follow."""
    masks = []
    for i in range(len(SEGMENTS)):
        parts = []
        for step in (1, 2):
            low, width = SEGMENTS[(i + step) % len(SEGMENTS)]
            half = width // 2
            parts += [_mask(low, half), _mask(low + half, width - half)]
        masks += [_mask(*SEGMENTS[i]) | x | y for x, y in combinations(parts, 2)]
    return masks


def fingerprints(docs: DataFrame, text: str = "text", to: str = "fp", width: int = 4) -> DataFrame:
    """Adds the fingerprint of the whole text as a signed long."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([_signed(fingerprint(x, width)) for x in batch], dtype="int64")

    return docs.withColumn(to, of(F.col(text)))


def _chain_holds(a: Column, b: Column) -> Column:
    """Some start keeps every prefix of the chain within its budget (the pigeonring test)."""
    diff = a.bitwiseXOR(b)
    apart = [F.bit_count(diff.bitwiseAND(F.lit(_signed(_mask(*s))))) for s in SEGMENTS]
    starts = []
    for i in range(len(SEGMENTS)):
        total, ok = F.lit(0), F.lit(True)
        for step, budget in enumerate(BUDGETS[:-1]):
            total = total + apart[(i + step) % len(SEGMENTS)]
            ok = ok & (total <= budget)
        starts.append(ok)
    out = starts[0]
    for other in starts[1:]:
        out = out | other
    return out


def _linked(a: Column, b: Column) -> Column:
    return _chain_holds(a, b) & (hamming(a, b) <= MAX_BITS)


def links(prints: DataFrame) -> DataFrame:
    """``(fp, label)`` for the distinct longs ``fp`` that link to another one."""
    keys = F.array(
        *[
            F.struct(F.lit(n).alias("n"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k"))
            for n, m in enumerate(key_masks())
        ]
    )
    keyed = prints.select("fp", F.explode(keys).alias("key")).select("fp", "key.n", "key.k")
    pivots = keyed.groupBy("n", "k").agg(F.min("fp").alias("pivot"), F.max("fp").alias("other"))
    pivots = pivots.where("pivot != other").drop("other")
    shared = materialise(keyed.join(pivots.hint(SHUFFLED), ["n", "k"]))
    star = shared.where(F.col("fp") != F.col("pivot")).where(_linked(F.col("fp"), F.col("pivot")))
    tied = components(star.select(F.col("fp").alias("a"), F.col("pivot").alias("b")))
    tied = tied.select(F.col("node").alias("fp"), "label")
    known = shared.select("n", "k", "fp").join(tied.hint(SHUFFLED), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    left = known.select("n", "k", F.col("fp").alias("fa"), F.col("label").alias("la"))
    right = known.select("n", "k", F.col("fp").alias("fb"), F.col("label").alias("lb"))
    rest = left.join(right.hint(SHUFFLED), ["n", "k"]).where(
        (F.col("la") < F.col("lb")) & _linked(F.col("fa"), F.col("fb"))
    )
    merged = components(rest.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    merged = merged.select(F.col("node").alias("label"), F.col("label").alias("last"))
    ends = tied.join(merged.hint(SHUFFLED), "label", "full_outer").select(
        F.coalesce("fp", "label").alias("fp"), F.coalesce("last", "label").alias("label")
    )
    # A label that is itself a lone fingerprint comes only from `merged`.
    return ends.distinct()


def _labelled(prints: DataFrame) -> DataFrame:
    """``fp, label`` for every fingerprint of ``prints``; alone, a fingerprint is its own label."""
    each = prints.select("fp").distinct()
    linked = materialise(links(each))
    return each.join(linked.hint(SHUFFLED), "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` for every row.

    Null and word-less texts have fingerprint zero and link like any other.  A repeated
    row keeps its own row in the result.  ``component_id`` is the least non-null doc_id
    that can be reached; it is null only if no row of the component has one.  An empty
    table gives an empty result; further columns of the input are not read.
    """
    prints = materialise(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).drop("text"))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    placed = least.join(_labelled(prints).hint(SHUFFLED), "fp")
    heads = placed.groupBy("label").agg(F.min("least").alias("component_id"))
    of_print = placed.select("fp", "label").join(heads.hint(SHUFFLED), "label").select("fp", "component_id")
    return prints.join(of_print.hint(SHUFFLED), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group: the one with the least doc_id (null ids last).

    Among rows of one id a hash of the text decides; of equal rows one stays.
    """
    keyed = docs.select(
        as_doc(docs), F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1)).alias("o"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.col(text).alias("text"),
    )
    prints = materialise(fingerprints(keyed.select("o", "h", "text")).drop("text"))
    placed = prints.join(_labelled(prints).hint(SHUFFLED), "fp")
    heads = placed.groupBy("label").agg(F.min(F.struct("o", "h")).alias("head")).select("head.o", "head.h")
    kept = keyed.drop("text").join(heads.hint(SHUFFLED), ["o", "h"], "left_semi").dropDuplicates(["o", "h"])
    return kept.select(*from_doc(docs))
