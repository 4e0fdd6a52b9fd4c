"""Near-duplicate vectors by cosine: int8 tile products with error bounds, exact where they cannot tell.

Equal vectors are one class.  Classes lie in blocks, and every two blocks meet in one tile.  Of a
unit vector u the tile has int8 codes q and a scale s, and the length e of what s q misses.  The
product of two unit vectors differs from s t (q . p) by e + f + e f at most, so pairs are told apart by
whole numbers: products of codes are exact in single precision as long as they stay below
2^24.  Only pairs whose bounds do not tell are computed again, in double precision from the
vectors themselves.  A tile returns a row for each of its classes that has links, with their number
and one class of the same component, and never its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silkmill.llm.common import components, materialise

THRESHOLD = 0.9
LEVELS = 127
#: Rows of a block: enough blocks for the machines, and not more bytes than a task should hold.
MIN_ROWS, MAX_ROWS, MANY_BLOCKS, BLOCK_BYTES = 1024, 16384, 16, 16 << 20
#: Rows of a block that meet the other one at once, and pairs that are computed again at once.
STRIP_ROWS, PAIRS_AT_ONCE = 256, 1 << 14
#: Beyond so many dimensions a product of codes may pass 2^24, so sums are made in parts.
EXACT_DIMS = (1 << 24) // LEVELS**2
#: More than rounding in double precision can be.
ROUNDING = 1e-9


def class_keys(arrays: pa.Array) -> pa.Array:
    """Digest of each vector's components as doubles; null for vectors that link with nothing."""
    if isinstance(arrays, pa.ChunkedArray):
        arrays = arrays.combine_chunks()
    values = arrays.values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) + 0.0  # no negative zero
    ends = arrays.offsets.to_numpy()
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    some = np.concatenate([[0], np.cumsum(values != 0)])
    fit = (bad[ends[1:]] == bad[ends[:-1]]) & (some[ends[1:]] > some[ends[:-1]]) & arrays.is_valid().to_numpy(zero_copy_only=False)
    view = memoryview(np.ascontiguousarray(values)).cast("B")
    out = [hashlib.sha256(view[8 * a : 8 * b]).digest() if ok else None for ok, a, b in zip(fit.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return pa.array(out, pa.binary())


def unscaled(rows: np.ndarray) -> np.ndarray:
    """Rows in double precision, each times a power of two, so that no square overflows; cosines stay as they are."""
    _, power = np.frexp(np.abs(rows).max(axis=1))
    return np.ldexp(rows.astype(np.float64), -power[:, None])


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number products of all rows of codes, held in single precision."""
    dims = a.shape[1]
    if dims <= EXACT_DIMS:
        return a @ b.T
    parts = [(a[:, k : k + EXACT_DIMS] @ b[:, k : k + EXACT_DIMS].T).astype(np.float64) for k in range(0, dims, EXACT_DIMS)]
    return np.sum(parts, axis=0)


class Block:
    """Codes, scales and error bounds of some vectors, and the vectors."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        full = unscaled(rows)
        self.squares = np.einsum("ij,ij->i", full, full)
        unit = full / np.sqrt(self.squares)[:, None]
        self.scale = np.abs(unit).max(axis=1) / LEVELS
        self.codes = np.rint(unit / self.scale[:, None]).astype(np.int8)
        self.error = np.sqrt(((unit - self.scale[:, None] * self.codes) ** 2).sum(axis=1)) + ROUNDING

    def linked(self, other: Block, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows with a cosine of ``threshold`` or more, strip by strip; of one block with itself each pair once."""
        least = threshold - other.error.max() * (1 + self.error) - self.error
        # The largest scale needs the smallest product; where that may be negative, the smallest scale does.
        cut = least / np.where(least > 0, self.scale * other.scale.max(), self.scale * other.scale.min())
        codes = other.codes.astype(np.float32)
        for a in range(0, len(self.rows), STRIP_ROWS):
            b = min(a + STRIP_ROWS, len(self.rows))
            product = code_products(self.codes[a:b].astype(np.float32), codes)
            i, j = np.nonzero(product >= (cut[a:b, None] - 0.001).astype(product.dtype))  # the division rounds, too
            i, value = i + a, product[i, j].astype(np.float64)
            if same:
                once = i < j
                i, j, value = i[once], j[once], value[once]
            value = value * self.scale[i] * other.scale[j]
            bound = self.error[i] + other.error[j] + self.error[i] * other.error[j]
            keep = value - bound >= threshold
            unsure = np.flatnonzero(~keep & (value + bound >= threshold))
            for k in range(0, len(unsure), PAIRS_AT_ONCE):
                at = unsure[k : k + PAIRS_AT_ONCE]
                keep[at] = self.cosines(i[at], other, j[at]) >= threshold
            if keep.any():
                yield i[keep], j[keep]

    def cosines(self, i: np.ndarray, other: Block, j: np.ndarray) -> np.ndarray:
        """Cosines of pairs in double precision."""
        dots = np.einsum("ij,ij->i", unscaled(self.rows[i]), unscaled(other.rows[j]))
        return dots / np.sqrt(self.squares[i] * other.squares[j])


class Forest:
    """Components of numbered nodes under links that come in arrays."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            la, lb = self.label[a], self.label[b]
            apart = la != lb
            if not apart.any():
                return
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            parent = np.arange(len(self.label))
            np.minimum.at(parent, np.maximum(la, lb), np.minimum(la, lb))
            while not np.array_equal(up := parent[parent], parent):
                parent = up
            self.label = parent[self.label]


def tile(one: Block, one_weights: np.ndarray, two: Block, two_weights: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes with links (those of the second block after those of the first), their numbers of links, and a node of their component."""
    shift = 0 if same else len(one.rows)
    n = len(one.rows) if same else shift + len(two.rows)
    counts, forest = np.zeros(n, np.int64), Forest(n)
    for i, j in one.linked(two, threshold, same):
        counts[: len(one.rows)] += np.bincount(i, two_weights[j], len(one.rows)).astype(np.int64)
        counts[shift:] += np.bincount(j, one_weights[i], len(two.rows)).astype(np.int64)
        forest.join(i, j + shift)
    at = np.flatnonzero(counts)
    return at, counts[at], forest.label[at]


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept``: a row for each vector, linked by cosines of ``threshold`` (over 0) and more.

    Vectors that are null, empty, zero, or hold null or non-finite components have no links and are their
    own component.  Vectors of different lengths never meet.  Copies link with each other and count each; a
    repeated id is another vector.  A null id takes part and comes last: a component's id is null only if all of its ids
    are, and such rows are kept.  An empty table gives an empty result; other columns are not read.  Ids are whole numbers.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0, and 1 at most")
    single = vectors.schema[embedding].dataType.elementType.simpleString() == "float"
    kind = np.float32 if single else np.float64
    key = F.arrow_udf(class_keys, "binary")
    last = F.lit((1 << 63) - 1)
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("e")).withColumn("key", key("e"))
    classes = rows.where(F.col("key").isNotNull()).groupBy("key").agg(
        F.min(F.coalesce("id", last)).alias("o"), F.count(F.lit(1)).alias("weight"), F.any_value("e").alias("e")
    )
    classes = materialise(classes.withColumn("dims", F.size("e")))
    bytes_ = F.lit(BLOCK_BYTES) / (F.col("dims") * (np.dtype(kind).itemsize + 1))
    wanted = F.least(F.greatest(F.ceil(F.col("n") / MANY_BLOCKS), F.lit(MIN_ROWS)), F.lit(MAX_ROWS), F.greatest(F.ceil(bytes_), F.lit(64)))
    sizes = classes.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).select("dims", F.ceil(F.col("n") / wanted).alias("blocks"))
    # k different lengths need k (k + 1) / 2 components at least, so this table is at most the root of twice the data.
    placed = classes.join(F.broadcast(sizes), "dims").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = np.stack(pdf["e"].to_numpy()).astype(kind)
        ids = np.stack([pdf["o"].to_numpy(np.int64), pdf["weight"].to_numpy(np.int64)])
        first = pdf.iloc[0]
        payload = b"".join([ids.tobytes(), *pdf["key"], rows.tobytes()])
        return pd.DataFrame({"dims": [first["dims"]], "block": [first["block"]], "blocks": [first["blocks"]], "n": [len(pdf)], "payload": [payload]})

    blocks = materialise(placed.groupBy("dims", "block").applyInPandas(pack, "dims int, block long, blocks long, n int, payload binary"))

    def side(mark: str, from_: Column, to: Column, own: str, other: str) -> DataFrame:
        return blocks.select("dims", F.col("block").alias(own), F.explode(F.sequence(from_, to)).alias(other), F.col("n").alias(f"n_{mark}"), F.col("payload").alias(mark))

    one = side("one", F.col("block"), F.col("blocks") - 1, "i", "j")
    two = side("two", F.lit(0).cast("long"), F.col("block"), "j", "i")
    met = one.join(two, ["dims", "i", "j"])

    def unpack(payload: bytes, n: int, dims: int) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        o, weight = np.frombuffer(payload, np.int64, 2 * n).reshape(2, n)
        keys = [payload[16 * n + 32 * k : 16 * n + 32 * k + 32] for k in range(n)]
        return o, weight, keys, np.frombuffer(payload, kind, n * dims, 48 * n).reshape(n, dims)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                same = r.i == r.j
                o, weight, keys, rows = unpack(r.one, r.n_one, r.dims)
                o2, weight2, keys2, rows2 = (o, weight, keys, rows) if same else unpack(r.two, r.n_two, r.dims)
                first = Block(rows)
                at, counts, roots = tile(first, weight, first if same else Block(rows2), weight2, same, threshold)
                if not same:
                    o, keys = np.concatenate([o, o2]), keys + keys2
                yield pd.DataFrame({"o": o[at], "key": [keys[k] for k in at], "links": counts, "ro": o[roots], "rkey": [keys[k] for k in roots]})

    found = met.select("dims", "i", "j", "n_one", "n_two", "one", "two").mapInPandas(search, "o long, key binary, links long, ro long, rkey binary")
    found = materialise(found)
    edges = found.select(F.struct("o", "key").alias("a"), F.struct(F.col("ro").alias("o"), F.col("rkey").alias("key")).alias("b"))
    joined = components(edges).select(F.col("node.key").alias("key"), F.col("label.o").alias("least"))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    told = classes.select("key", "o", "weight").join(links, "key", "left").join(joined, "key", "left").select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("least", "o").alias("least")
    )
    out = rows.select("id", "key").join(materialise(told), "key", "left")
    least = F.when(F.col("least").isNull(), F.col("id")).otherwise(F.nullif("least", last)).alias("component_id")
    out = out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), least)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
