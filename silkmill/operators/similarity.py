"""Similar files: MinHash bands find candidates, exact Jaccard of word shingles decides, components are groups.

A text is the set of its runs of five words.  Equal texts are one class, known by its least id.  Of a
class, ``BANDS`` bands of ``ROWS`` MinHash values are kept; two classes that share a band are candidates:
at a similarity of 0.8 all but some 2 of a million such pairs are.  The exact similarity of candidates is
computed from their sets, which are made for the classes that share a band only.

Classes that are candidates of each other, directly or by way of others, are a family.  Sets are brought together
by families, not by pairs, whose number grows with the square of a family: a task compares the candidates of many
small families, or of two blocks of a large one.  Groups don't need all pairs: what is linked already is not compared.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silkmill.operators.graph import SHUFFLED, components, materialise

#: Words of a shingle, similarity from which on files are similar.
WIDTH, THRESHOLD = 5, 0.8
#: MinHash bands and the values in each.
BANDS, ROWS, SEED = 25, 4, 7
#: Rows that meet one set of shingles in one task at most.
SHARE_ROWS = 4096
#: Shingles and classes of a block of a large family at most, about; shingles of a lot of small ones; bits of the map of candidates.
BLOCK_SHINGLES, BLOCK_CLASSES, LOT_SHINGLES, BITS = 1 << 20, 4096, 1 << 18, 1 << 24
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FEATURES = "struct<n: int, bands: array<long>>"


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Different 64-bit hashes of a text's runs of ``width`` words; a shorter text is one run, without a word there is none."""
    import xxhash

    words = WORD.findall(text or "")
    runs = {" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(x.encode()) for x in runs), np.uint64, len(runs)).view(np.int64))


def band_hashes(shingles: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A hash for each band: its number and the least values of ``rows`` multiply-shift hashes of the shingles."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    r = np.random.default_rng(SEED)
    factors = r.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    values, least = shingles.view(np.uint64), np.full(bands * rows, ~np.uint64(0))
    for k in range(0, len(values), 1024):
        mixed = values[k : k + 1024, None] * factors
        least = np.minimum(least, ((mixed ^ (mixed >> np.uint64(32))) * factors[::-1]).min(axis=0))
    out = np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        out = (out ^ least[k::rows][:bands]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def features(text: Column, width: int = WIDTH) -> Column:
    """The number of a text's shingles, and its bands."""

    @F.pandas_udf(FEATURES)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_hashes(x, width) for x in batch]
            yield pd.DataFrame({"n": [len(x) for x in sets], "bands": [band_hashes(x) for x in sets]})

    return of(text)


def sets(text: Column, width: int = WIDTH) -> Column:
    """Shingles of a text, and its bands."""

    @F.pandas_udf("struct<bands: array<long>, shingles: array<long>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shingle_hashes(x, width) for x in batch]
            yield pd.DataFrame({"bands": [band_hashes(x) for x in found], "shingles": found})

    return of(text)


def _rows(files: DataFrame, key: str, text: str) -> DataFrame:
    """``id, text, digest``; rows without an id take no part."""
    rows = files.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def classes(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """``class, digest, n, bands`` of the classes of ``rows``: equal texts, by their least id.  Texts stay where they are read."""
    each = rows.select("id", "digest", features(F.col("text"), width).alias("f"))
    return materialise(each.groupBy("digest").agg(F.min("id").alias("class"), F.first("f").alias("f")).select("class", "digest", "f.n", "f.bands"))


def _edges(found: DataFrame) -> DataFrame:
    """``a, b``: the least class of every band that two or more classes share, and another one of them."""
    each = found.select("class", F.explode(F.array_distinct("bands")).alias("band")).where("class IS NOT NULL AND band IS NOT NULL").repartition("band")  # one shuffle serves both sides
    least = each.groupBy("band").agg(F.min("class").alias("least"), F.max("class").alias("most")).where("least != most").select("band", "least")
    return each.join(least.hint(SHUFFLED), "band").where("class != least").select(F.col("least").alias("a"), F.col("class").alias("b")).distinct()


def placed(found: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, digest, family, blocks, block, lot`` of the classes with ``edges``: a family is a component of them, cut into blocks if it is large.

    Families of one block share lots, by a hash.
    """
    family = components(edges).select(F.col("node").alias("class"), F.col("label").alias("family"))
    own = materialise(found.select("class", "digest", "n").join(family.hint(SHUFFLED), "class"))
    blocks = F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES)).cast("int")
    families = materialise(own.groupBy("family").agg(blocks.alias("blocks"), F.sum("n").alias("all")))
    lots = max(1, (families.where("blocks = 1").agg(F.sum("all")).first()[0] or 0) // LOT_SHINGLES)
    return own.join(families.drop("all").hint(SHUFFLED), "family").select(
        F.col("class").alias("id"), "digest", "family", "blocks", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int").alias("block"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("family"), F.lit(lots))).otherwise(F.lit(-1)).cast("long").alias("lot"),
    )


def passing(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` without most of those whose id is not in ``ids``, without a shuffle: by a bitmap of hashes, of ``BITS`` bits whatever the number of ids."""
    words = np.zeros(BITS // 64, np.int64)
    spot = F.pmod(F.xxhash64("id"), F.lit(BITS))
    marks = ids.select(spot.alias("s")).groupBy(F.shiftright("s", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(s % 64 AS INT))")).alias("bits")).toArrow()
    words[marks["word"].to_numpy()] = marks["bits"].to_numpy()

    @F.pandas_udf("boolean")
    def may_be(spots: pd.Series) -> pd.Series:
        at = spots.to_numpy()
        return pd.Series((words[at >> 6] >> (at & 63)) & 1 == 1)

    return rows.where(may_be(spot))


def shared_sets(rows: DataFrame, found: DataFrame, width: int = WIDTH) -> DataFrame:
    """``class, family, blocks, block, lot, bands, shingles`` of the classes of ``found`` that share a band: others are compared with none, so their
    sets, as large as the texts, are not kept, and most of their texts not shuffled."""
    near = materialise(placed(found, materialise(_edges(found))))
    # The first file of a class is met by id and digest together: no task gets all copies' texts.
    own = passing(rows, near).join(near.hint(SHUFFLED), ["id", "digest"]).dropDuplicates(["id", "digest"])
    return materialise(own.select(F.col("id").alias("class"), "family", "blocks", "block", "lot", sets(F.col("text"), width).alias("f")).select("*", "f.*").drop("f"))


class _Lot:
    """Classes of one lot, or of one or two blocks of a family: their sets as codes, one after the other, and who shares a band."""

    def __init__(self, rows: pd.DataFrame):
        order = sorted(range(len(rows)), key=rows["class"].tolist().__getitem__)
        rows = rows.iloc[order]
        self.ids, self.block = rows["class"].tolist(), rows["block"].to_numpy()
        self.size = np.array([len(x) for x in rows["shingles"]], np.int64)
        self.start = np.cumsum(self.size) - self.size
        kinds, self.codes = np.unique(np.concatenate(rows["shingles"].tolist()), return_inverse=True)
        self.marked = np.zeros(len(kinds), bool)
        _, bands = np.unique(np.concatenate(rows["bands"].tolist()), return_inverse=True)
        holder = np.repeat(np.arange(len(rows)), [len(x) for x in rows["bands"]])
        by_band = np.argsort(bands, kind="stable")
        self.holders, ends = holder[by_band], np.cumsum(np.bincount(bands))[bands[by_band]]
        places = np.flatnonzero(np.arange(1, len(ends) + 1) < ends)  # of holders that are not their band's last
        places = places[np.argsort(self.holders[places], kind="stable")]
        cuts = np.searchsorted(self.holders[places], np.arange(len(rows) + 1))
        self.later = [list(zip(places[i:j] + 1, ends[places[i:j]])) for i, j in zip(cuts, cuts[1:])]

    def candidates(self, k: int) -> np.ndarray:
        """Classes after ``k`` that share a band with it."""
        return np.unique(np.concatenate([self.holders[i:j] for i, j in self.later[k]])) if self.later[k] else np.zeros(0, np.int64)

    def similarity(self, k: int, to: np.ndarray) -> np.ndarray:
        """Exact Jaccard similarity of ``k`` to the classes ``to``, which are not empty."""
        own = self.codes[self.start[k] : self.start[k] + self.size[k]]
        size = self.size[to]
        begin = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(self.start[to] - begin, size)
        self.marked[own] = True
        both = np.add.reduceat(self.marked[self.codes[at]], begin, dtype=np.int64)
        self.marked[own] = False
        return both / (self.size[k] + size - both)


def links(rows: pd.DataFrame, threshold: float, every: bool, across: bool) -> list[tuple]:
    """``a, b, similarity, settled`` of a lot, or (``across``) of pairs of different blocks of a family.

    All links if ``every``; else, for families of one block, each member of a group with its least one (settled), for others
    links enough to join what is linked.
    """
    lot, out = _Lot(rows), []
    whole = not every and rows["blocks"].iat[0] == 1
    root = np.arange(len(lot.ids))
    for k in range(len(lot.ids)):
        to = lot.candidates(k)
        least, most = np.minimum(lot.size[to], lot.size[k]), np.maximum(lot.size[to], lot.size[k])
        to = to[(least / most >= threshold) & (every | (root[to] != root[k])) & ((lot.block[to] != lot.block[k]) | (not across))]
        if not len(to):
            continue
        alike = lot.similarity(k, to)
        for b, x in zip(to[alike >= threshold], alike[alike >= threshold]):
            if every or root[b] != root[k]:
                if not whole:
                    out.append((lot.ids[k], lot.ids[b], float(x), False))
                first, second = sorted((root[b], root[k]))
                root[root == second] = first
    if whole:
        for k in np.unique(root[root != np.arange(len(root))]):
            to = np.flatnonzero(root == k)[1:]
            out += [(lot.ids[k], lot.ids[b], float(x), True) for b, x in zip(to, lot.similarity(k, to))]
    return out


def linked(near: DataFrame, threshold: float, every: bool) -> DataFrame:
    """:func:`links` of the classes of ``near`` (:func:`shared_sets`).  A set is shuffled once for each block of its family, not once for each candidate."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = near.select("class", "block", "blocks", "lot", F.when(F.col("blocks") > 1, F.col("family")).alias("family"), "bands", "shingles", other)
    dealt = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")
    kind = near.schema["class"].dataType.simpleString()

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(links(rows, threshold, every, bool(rows["i"].iat[0] != rows["j"].iat[0])), columns=["a", "b", "similarity", "settled"])

    return dealt.groupBy("lot", "family", "i", "j").applyInPandas(compare, f"a {kind}, b {kind}, similarity double, settled boolean")


def with_set(pairs: DataFrame, sets: DataFrame, key: str, to: str) -> DataFrame:
    """``pairs`` with the shingles of their class ``key``; a class with very many pairs is dealt to several tasks."""
    shares = pairs.groupBy(F.col(key).alias("class")).agg(F.ceil(F.count(F.lit(1)) / SHARE_ROWS).cast("int").alias("shares"))
    shares = materialise(shares)
    copies = sets.join(shares, "class").select(F.col("class").alias("_class"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("_share"), F.col("shingles").alias(to))
    dealt = pairs.join(shares.withColumnRenamed("class", key), key).withColumn("_share", F.pmod(F.xxhash64(*pairs.columns), F.col("shares")).cast("int")).drop("shares")
    return dealt.join(copies, (F.col(key) == F.col("_class")) & (dealt["_share"] == copies["_share"])).drop("_class", "_share")


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays of different elements; 0 if one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, similarity`` of pairs of classes."""
    both = with_set(with_set(pairs, sets, "a", "sa"), sets, "b", "sb")
    return both.select("a", "b", jaccard(F.col("sa"), F.col("sb")).alias("similarity"))


def near_pairs(files: DataFrame, key: str = "url", text: str = "code", threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """``a, b, similarity``: every found pair of different texts with a similarity of ``threshold`` or more, by least ids, a < b.

    Copies are members of their class (:func:`classes`) and are not expanded.  Texts without a word are similar to none.
    """
    rows = _rows(files, key, text)
    return linked(shared_sets(rows, classes(rows, width), width), threshold, True).drop("settled")


def members(files: DataFrame, key: str = "url", text: str = "code", threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """``id, group_id, similarity`` of every file: its group's least id, and how similar it is to that file.

    A file that is similar to no other one is its own group; copies have similarity 1.
    """
    rows = _rows(files, key, text)
    each = classes(rows, width)
    near = shared_sets(rows, each, width)
    found = materialise(linked(near, threshold, False))
    label = components(found.where("NOT settled"))
    apart = materialise(label.where("node != label").select(F.col("label").alias("a"), F.col("node").alias("b")))
    late = compared(apart, near.where("blocks > 1").select("class", "shingles"))  # of families in several blocks
    told = found.where("settled").drop("settled").unionByName(late).select(F.col("b").alias("class"), F.col("a").alias("group_id"), "similarity")
    told = each.select("class").join(told, "class", "left")
    told = materialise(told.select("class", F.coalesce("group_id", "class").alias("group_id"), F.coalesce("similarity", F.lit(1.0)).alias("similarity")))
    of_class = rows.select("id", "digest").join(each.select("digest", "class"), "digest")
    return of_class.join(told, "class").select("id", "group_id", "similarity")


def groups(files: DataFrame, key: str = "url", text: str = "code", size: str = "size", threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """One row for each group of two or more files: ``group_id, represent_file, member_count``, average, least and greatest similarity of the
    members to the file that represents them (itself left out), and ``total_saved_size``, the bytes of the others.

    The members are rows of :func:`members`; no row holds a whole group.
    """
    sizes = files.groupBy(F.col(key).alias("id")).agg(F.max(size).cast("long").alias("size"))
    rows = members(files, key, text, threshold, width).dropDuplicates(["id"]).join(sizes, "id")
    others = F.col("id") != F.col("group_id")
    out = rows.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("member_count"), *[f(F.when(others, F.col("similarity"))).alias(f"{n}_similarity") for f, n in ((F.avg, "avg"), (F.min, "min"), (F.max, "max"))],
        F.sum(F.when(others, F.col("size"))).alias("total_saved_size"),
    )
    return out.where("member_count > 1").withColumn("represent_file", F.col("group_id"))
