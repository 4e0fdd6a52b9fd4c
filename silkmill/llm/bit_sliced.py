"""Exact top-k search by inner product over a bit-sliced index.

Vectors of integers lie in blocks of ``BLOCK_ROWS``.  In a block every attribute, less its
minimum, is stored as bitmaps: slice k of attribute d has bit k of all its rows.  For a query
the upper slices (the ``DROPPED`` lowest ones are left out) are added with bitmap arithmetic,
weighted by the query's bits; a negative weight takes the complement.  Carry-save adders work
on all bitmaps of one significance at once.  The sums are again slices, and the best rows are
selected from the most significant slice downward.  What the dropped slices can add is
bounded, and every row within that bound is resolved exactly from its integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from silkmill.llm.common import materialise

BLOCK_ROWS = 4096
QUERY_ROWS = 128
#: Lowest slices left out of the bitmap sums, where the attribute has more than KEPT slices.
KEPT = 8


class SlicedBlock:
    """Bit-sliced index of one block of integer rows: ``slices`` of what is over each attribute's ``low``, and that itself."""

    def __init__(self, low: np.ndarray, over: np.ndarray, bits: int, slices: np.ndarray):
        self.low, self.over, self.bits, self.slices = low, over, bits, slices
        self.dropped = max(0, bits - KEPT)
        valid = np.zeros(slices.shape[2] * 8, np.uint8)
        mask = np.packbits(np.ones(len(over), np.uint8), bitorder="little")
        valid[: len(mask)] = mask
        self.valid = valid.view(np.uint64)

    @classmethod
    def build(cls, rows: np.ndarray) -> SlicedBlock:
        n, dims = rows.shape
        low = rows.min(axis=0)
        over = rows - low
        bits = max(1, int(over.max()).bit_length())
        dropped = max(0, bits - KEPT)
        slices = np.zeros((dims, bits - dropped, (n + 63) // 64 * 8), np.uint8)
        for k in range(bits - dropped):
            packed = np.packbits(((over >> (dropped + k)) & 1).astype(np.uint8).T, axis=1, bitorder="little")
            slices[:, k, : packed.shape[1]] = packed
        narrow = next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if bits <= np.iinfo(t).bits - (t is np.int64))
        return cls(low, over.astype(narrow), bits, slices.view(np.uint64))

    def to_bytes(self) -> bytes:
        head = np.array([*self.over.shape, self.bits, self.slices.shape[1], ord(self.over.dtype.char)], np.int64)
        return b"".join(x.tobytes() for x in (head, self.low, self.slices, self.over))

    @classmethod
    def from_bytes(cls, payload: bytes) -> SlicedBlock:
        n, dims, bits, kept, char = np.frombuffer(payload, np.int64, 5).tolist()
        low, words = np.frombuffer(payload, np.int64, dims, 40), (n + 63) // 64
        slices = np.frombuffer(payload, np.uint64, dims * kept * words, 40 + 8 * dims)
        over = np.frombuffer(payload, np.dtype(chr(char)), n * dims, 40 + 8 * (dims + len(slices)))
        return cls(low, over.reshape(n, dims), bits, slices.reshape(dims, kept, words))

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, lowest first, of the sums of weighted upper slices; complements for negative weights."""
        weight = np.abs(query)
        places: dict[int, list[tuple[int, int]]] = {}
        for j in range(int(weight.max()).bit_length() if len(weight) else 0):
            for d in np.flatnonzero((weight >> j) & 1).tolist():
                for k in range(self.slices.shape[1]):
                    places.setdefault(j + k, []).append((d, k))
        flip = np.where(query < 0, ~np.uint64(0), np.uint64(0))
        out, p, carried = [], 0, np.zeros((0, len(self.valid)), np.uint64)
        top = max(places, default=-1)
        while p <= top or len(carried):
            if at := places.get(p):
                d, k = np.array(at).T
                column = np.concatenate([self.slices[d, k] ^ flip[d][:, None], carried])
            else:
                column = carried
            carries = []
            while len(column) > 2:
                third = len(column) // 3
                a, b, c = column[:third], column[third : 2 * third], column[2 * third : 3 * third]
                ab = a ^ b
                carries.append((a & b) | (c & ab))
                column = np.concatenate([ab ^ c, column[3 * third :]])
            if len(column) == 2:
                carries.append((column[0] & column[1])[None])
                column = (column[0] ^ column[1])[None]
            out.append(column[0] & self.valid if len(column) else np.zeros_like(self.valid))
            carried = np.concatenate(carries) if carries else np.zeros((0, len(self.valid)), np.uint64)
            p += 1
        return out

    def _kth(self, sums: list[np.ndarray], k: int) -> int:
        """The k-th largest sum, found from the most significant slice downward."""
        above, level, value = np.zeros_like(self.valid), self.valid, 0
        for p in range(len(sums) - 1, -1, -1):
            ones = level & sums[p]
            if int(np.bitwise_count(above | ones).sum()) >= k:
                level, value = ones, value | (1 << p)
            else:
                above, level = above | ones, level & ~sums[p]
        return value

    def _at_least(self, sums: list[np.ndarray], value: int) -> np.ndarray:
        """Rows whose sum is ``value`` or more."""
        if value <= 0:
            bitmap = self.valid
        elif value.bit_length() > len(sums):
            return np.zeros(0, np.int64)
        else:
            greater, equal = np.zeros_like(self.valid), self.valid
            for p in range(len(sums) - 1, -1, -1):
                if value >> p & 1:
                    equal = equal & sums[p]
                else:
                    greater, equal = greater | (equal & sums[p]), equal & ~sums[p]
            bitmap = greater | equal
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))

    def candidates(self, query: np.ndarray, k: int) -> np.ndarray:
        """Rows that may be among the k best."""
        if len(self.over) <= k:
            return np.arange(len(self.over))
        sums = self.sums(query)
        # A dropped part is 0 .. 2^dropped - 1 for each attribute, kept parts count 2^dropped.
        slack = int(np.abs(query).sum()) * ((1 << self.dropped) - 1) >> self.dropped
        return self._at_least(sums, self._kth(sums, k) - slack)

    def top(self, query: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and exact scores of the k best, ties to the smaller id; ``own`` marks rows that are left out."""
        at = self.candidates(query, k + int(own.sum()))
        at = at[~own[at]]
        score = (self.over[at].astype(np.int64) + self.low) @ query
        order = np.lexsort((ids[at], -score))[:k]
        return at[order], score[order]


def top_k(
    vectors: DataFrame, query_if, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 1024
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows for each row where ``query_if`` holds.

    Components become floor(scale * x), x as double; the score is the integer inner product.
    Vectors that are null, empty, or hold null or non-finite components, and rows without an
    id, take no part.  Vectors of different lengths never meet.  A row is no candidate for
    itself; a repeated row is one for its copy.  Ties go to the smaller vec_id.  An empty table
    gives an empty result; other columns are not read.
    """
    x = F.col("e")
    v = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("e"), query_if.alias("is_query"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    v = v.where(F.col("id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite)
    v = v.select(
        F.monotonically_increasing_id().alias("row"), "id", F.coalesce("is_query", F.lit(False)).alias("is_query"),
        F.size(x).alias("dims"), F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("v"),
    )
    v = materialise(v)
    sizes = v.groupBy("dims").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_query").alias("nq"))
    sizes = sizes.select(
        "dims", F.ceil(F.col("n") / BLOCK_ROWS).alias("blocks"), F.ceil(F.col("nq") / QUERY_ROWS).alias("query_blocks")
    )
    spot = F.xxhash64("row")
    placed = v.join(F.broadcast(sizes), "dims")

    def pack(pdf: pd.DataFrame, sliced: bool) -> pd.DataFrame:
        rows = np.stack(pdf["v"].to_numpy()).astype(np.int64)
        ids = np.stack([pdf["row"].to_numpy(np.int64), pdf["id"].to_numpy(np.int64)])
        return pd.DataFrame({
            "dims": [int(pdf["dims"].iloc[0])], "block": [int(pdf["block"].iloc[0])], "ids": [ids.tobytes()],
            "payload": [SlicedBlock.build(rows).to_bytes() if sliced else rows.tobytes()],
        })

    packed = "dims int, block long, ids binary, payload binary"
    index = placed.withColumn("block", F.pmod(spot, F.col("blocks"))).groupBy("dims", "block")
    index = materialise(index.applyInPandas(lambda pdf: pack(pdf, True), packed))  # slices are made once, whatever number of query blocks reads them
    asked = placed.where("is_query").withColumn("block", F.pmod(spot, F.col("query_blocks")))
    asked = asked.groupBy("dims", "block").applyInPandas(lambda pdf: pack(pdf, False), packed)
    index = index.join(F.broadcast(sizes), "dims").where("query_blocks > 0").select(
        "dims", F.col("ids").alias("index_ids"), F.col("payload").alias("index"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_blocks") - 1)).alias("block"),
    )
    meet = index.join(asked, ["dims", "block"])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dims, index_ids, index, ids, payload in pdf.itertuples(index=False):
                row, own_ids = np.frombuffer(index_ids, np.int64).reshape(2, -1)
                q_row, q_ids = np.frombuffer(ids, np.int64).reshape(2, -1)
                queries, block, found = np.frombuffer(payload, np.int64).reshape(-1, dims), SlicedBlock.from_bytes(index), []
                for n in range(len(q_row)):
                    at, score = block.top(queries[n], own_ids, row == q_row[n], k)
                    found.append(pd.DataFrame({"q": q_row[n], "query_id": q_ids[n], "vec_id": own_ids[at], "score": score}))
                yield pd.concat(found)

    found = meet.select("dims", "index_ids", "index", "ids", "payload")
    local = found.mapInPandas(search, "q long, query_id long, vec_id long, score long")
    best = W.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
