"""Removal of repeated 100-byte strings across documents, by suffix arrays.

Every string of 100 bytes has an anchor, a run of 32 bytes in it chosen by content, so equal
strings have equal anchors.  Anchors are grouped by hash; around those that stand in two
places the bytes that strings with this anchor can cover (the context) are gathered, and a
suffix array over a bucket of contexts, with its common prefixes, tells which strings also
start earlier.  A repeated string is in the bucket with all its equals, so the result is exact.

Buckets are sized by the corpus.  Texts that are equal as a whole count once from the first
grouping on; of equal contexts a bucket keeps the first two, further ones share the
second's result, so a passage in thousands of documents adds two contexts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silkmill.llm.anchors import ANCHOR, LENGTH, anchors
from silkmill.llm.common import materialise, stored
from silkmill.llm.suffix_array import repeats

#: Corpus bytes per bucket of anchors and of contexts.
ANCHOR_BUCKET, CONTEXT_BUCKET = 96 << 20, 2 << 20
#: Bytes of text handled at once on a worker.
TEXT_BLOCK = 4 << 20
#: A context: this many bytes before the anchor, the anchor, as many after it; never in UTF-8: 0xFF.
BEFORE = LENGTH - ANCHOR
WIDTH = BEFORE + LENGTH
GAP = 0xFF
NO_ID = (1 << 63) - 1


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    begin, size = 0, 0
    for n, x in enumerate(texts):
        size += len(x)
        if size >= TEXT_BLOCK:
            yield begin, n + 1
            begin, size = n + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _packed(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(x.tobytes() for x in arrays), 1)


def _parts(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of each bucket."""
    order = np.argsort(bucket, kind="stable")
    values, begins = np.unique(bucket[order], return_index=True)
    for value, rows in zip(values.tolist(), np.split(order, begins[1:]), strict=True):
        yield value, rows


def _anchor_rows(buckets: int):
    """Texts to anchors, packed per block and bucket: hashes, places and documents."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [x.encode("utf-8") for x in pdf["text"]]
            o, h = pdf["o"].to_numpy(np.int64), pdf["h1"].to_numpy(np.int64)
            for a, b in _blocks(texts):
                starts = np.cumsum([0, *map(len, texts[a : b - 1])])
                place, hashes = anchors(b"".join(texts[a:b]), starts)
                doc = np.searchsorted(starts, place, "right") - 1
                place = place - starts[doc]
                rows = []
                for bucket, at in _parts((hashes >> np.uint64(20)) % np.uint64(buckets)):
                    docs, local = np.unique(doc[at], return_inverse=True)
                    # Five bytes of the hash do: the bucket has others, and contexts are compared in full.
                    few = np.ascontiguousarray(hashes[at]).view(np.uint8).reshape(-1, 8)[:, 3:]
                    step = np.diff(place[at], prepend=0).astype(np.int32)
                    turn = np.diff(local, prepend=0).astype(np.uint16)
                    rows.append((bucket, len(at), len(docs), _packed(o[a:b][docs], h[a:b][docs], step, turn, few)))
                yield pd.DataFrame(rows, columns=["bucket", "n", "nd", "payload"])

    return of


def _repeated_anchors(pdf: pd.DataFrame) -> pd.DataFrame:
    """Places of the anchors of a bucket that stand in two places, equal texts counted once."""
    hashes, o, h, place = [], [], [], []
    for r in pdf.itertuples():
        n, nd, p = r.n, r.nd, zstandard.decompress(r.payload)
        docs = np.frombuffer(p, np.int64, 2 * nd)
        local = np.cumsum(np.frombuffer(p, np.uint16, n, 16 * nd + 4 * n), dtype=np.int64)
        few = np.zeros((n, 8), np.uint8)
        few[:, 3:] = np.frombuffer(p, np.uint8, 5 * n, 16 * nd + 6 * n).reshape(n, 5)
        hashes.append(few.view(np.uint64).ravel())
        o.append(docs[:nd][local])
        h.append(docs[nd:][local])
        place.append(np.cumsum(np.frombuffer(p, np.int32, n, 16 * nd), dtype=np.int64).astype(np.int32))
    hashes, o, h, place = map(np.concatenate, (hashes, o, h, place))
    _, inverse, count = np.unique(hashes, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[inverse] > 1)
    hashes, o, h, place = hashes[at], o[at], h[at], place[at]
    order = np.lexsort((o, place, h, hashes))
    hashes, o, h, place = hashes[order], o[order], h[order], place[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (h[1:] != h[:-1]) | (place[1:] != place[:-1])
    hashes, o, h, place = hashes[first], o[first], h[first], place[first]
    _, inverse, count = np.unique(hashes, return_inverse=True, return_counts=True)
    keep = count[inverse] > 1
    return pd.DataFrame({"o": o[keep], "h1": h[keep], "place": place[keep]})


def _context_rows(buckets: int):
    """Documents with their repeated anchors to contexts, packed per block and bucket."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [x.encode("utf-8") for x in pdf["text"]]
            places = [np.sort(np.asarray(x, np.int64)) for x in pdf["places"]]
            o, h = pdf["o"].to_numpy(np.int64), pdf["h1"].to_numpy(np.int64)
            for a, b in _blocks(texts):
                sizes = np.array([len(p) for p in places[a:b]])
                doc = np.repeat(np.arange(b - a), sizes)
                place = np.concatenate(places[a:b])
                edge = bytes([GAP]) * LENGTH
                joined = np.frombuffer(edge + edge.join(texts[a:b]) + edge, np.uint8)
                starts = LENGTH + np.cumsum([0, *[len(x) + LENGTH for x in texts[a : b - 1]]])
                left = starts[doc] + place - BEFORE
                for group in np.array_split(np.arange(len(place)), max(1, len(place) * WIDTH // TEXT_BLOCK)):
                    windows = joined[left[group][:, None] + np.arange(WIDTH)]
                    key = windows[:, BEFORE : BEFORE + ANCHOR].copy().view(np.uint64).reshape(-1, ANCHOR // 8)
                    mixed = np.zeros(len(group), np.uint64)
                    for k in range(ANCHOR // 8):
                        mixed = (mixed ^ key[:, k]) * np.uint64(0x9E3779B97F4A7C15)
                        mixed ^= mixed >> np.uint64(32)
                    rows = []
                    for bucket, at in _parts(mixed % np.uint64(buckets)):
                        docs, local = np.unique(doc[group[at]], return_inverse=True)
                        small = [place[group[at]].astype(np.int32), local.astype(np.int32)]
                        rows.append((bucket, len(at), len(docs), _packed(o[a:b][docs], h[a:b][docs], *small, windows[at])))
                    yield pd.DataFrame(rows, columns=["bucket", "n", "nd", "payload"])

    return of


def _repeated_spans(pdf: pd.DataFrame) -> pd.DataFrame:
    """Spans of documents that repeated strings of a bucket's contexts cover: one per context at most."""
    o, h, place, windows = [], [], [], []
    for r in pdf.itertuples():
        n, nd, p = r.n, r.nd, zstandard.decompress(r.payload)
        docs = np.frombuffer(p, np.int64, 2 * nd)
        small = np.frombuffer(p, np.int32, 2 * n, 16 * nd)
        o.append(docs[:nd][small[n:]])
        h.append(docs[nd:][small[n:]])
        place.append(small[:n].astype(np.int64))
        windows.append(np.frombuffer(p, np.uint8, n * WIDTH, 16 * nd + 8 * n).reshape(n, WIDTH))
    o, h, place, windows = map(np.concatenate, (o, h, place, windows))
    order = np.lexsort((place, h, o))
    o, h, place, windows = o[order], h[order], place[order], np.ascontiguousarray(windows[order])
    doc = np.cumsum(np.append(False, (o[1:] != o[:-1]) | (h[1:] != h[:-1])))
    same = np.unique(windows.view(f"V{WIDTH}").ravel(), return_inverse=True)[1].ravel()
    # Rows are in order of document and place: the first two of equal contexts stay.
    by_context = np.argsort(same, kind="stable")
    head = np.append(True, same[by_context][1:] != same[by_context][:-1])
    turn = np.arange(len(same)) - np.maximum.accumulate(np.where(head, np.arange(len(same)), 0))
    stands_for = by_context[np.arange(len(same)) - turn + np.minimum(turn, 1)]
    source = np.empty(len(same), np.int64)
    source[by_context] = stands_for
    kept = np.flatnonzero(source == np.arange(len(same)))
    sub = windows[kept]
    s = np.full((len(kept), WIDTH + 1), GAP, np.uint8)
    s[:, :WIDTH] = sub
    gap = np.cumsum(np.pad(sub == GAP, ((0, 0), (1, 0))), axis=1, dtype=np.int32)
    starts = np.arange(BEFORE + 1)
    whole = gap[:, starts + LENGTH] == gap[:, starts]
    rank = np.full(s.shape, -1, np.int64)
    order_of = (doc[kept].astype(np.int64) << 34) + place[kept]
    rank[:, : BEFORE + 1] = np.where(whole, order_of[:, None] + starts + 1, -1)
    found = repeats(s.ravel(), rank.ravel(), LENGTH)
    row, column = found // (WIDTH + 1), found % (WIDTH + 1)
    low, high = np.full(len(kept), WIDTH), np.full(len(kept), -1)
    np.minimum.at(low, row, column)
    np.maximum.at(high, row, column)
    of_kept = np.full(len(same), -1)
    of_kept[kept] = np.arange(len(kept))
    at = of_kept[source]
    hit = high[at] >= 0
    begin = place[hit] - BEFORE + low[at[hit]]
    size = high[at[hit]] - low[at[hit]] + LENGTH
    return pd.DataFrame({"o": o[hit], "h1": h[hit], "span": (begin << 8) | size})


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Removes the spans of each text and sums up what was removed."""
    for pdf in batches:
        rows = []
        for r in pdf.itertuples():
            raw = r.text.encode("utf-8")
            spans = np.sort(np.asarray(r.spans, np.int64))
            begin, end = spans >> 8, (spans >> 8) + (spans & 255)
            reach = np.maximum.accumulate(end)
            new = np.append(True, begin[1:] > reach[:-1])
            begins, ends = begin[new].tolist(), reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)].tolist()
            out, at = [], 0
            for a, b in zip(begins, ends, strict=True):
                out.append(raw[at:a])
                at = b
            kept = b"".join([*out, raw[at:]])
            rows.append((r.o, r.h1, len(raw) - len(kept), len(begins), hashlib.sha256(kept).hexdigest(), kept))
        yield pd.DataFrame(rows, columns=["o", "h1", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", real: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row; with ``real`` also ``kept`` (bytes).

    A byte goes if a string of 100 bytes that covers it also starts earlier: in a document with a
    smaller doc_id or earlier in the same one.  Null texts are empty.  Null ids come last.  Rows
    with one id and different texts are ordered by a hash of the text; of rows that are equal
    in both, one stays and the others count as later.  Texts under 100 bytes stay whole.  An
    empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("o"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).select("*", F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2"))
    info = rows.select("doc_id", "o", "h1", "h2", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("sha"))
    info = materialise(info)
    total = info.agg(F.sum("n_bytes")).first()[0] or 0
    texts = rows.where(F.octet_length("text") >= LENGTH).select("o", "h1", "text")
    packed = "bucket long, n int, nd int, payload binary"
    found = texts.mapInPandas(_anchor_rows(math.ceil(total / ANCHOR_BUCKET) or 1), packed)
    found = found.groupBy("bucket").applyInPandas(_repeated_anchors, "o long, h1 long, place int")
    places = found.groupBy("o", "h1").agg(F.collect_list("place").alias("places"))
    marked = stored(texts.join(places, ["o", "h1"]))
    contexts = marked.mapInPandas(_context_rows(math.ceil(total / CONTEXT_BUCKET) or 1), packed)
    spans = contexts.groupBy("bucket").applyInPandas(_repeated_spans, "o long, h1 long, span long")
    spans = spans.groupBy("o", "h1").agg(F.collect_list("span").alias("spans"))
    cut = "o long, h1 long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    cut = marked.select("o", "h1", "text").join(spans, ["o", "h1"]).mapInPandas(_cut, cut)
    # Equal rows of one id and text have equal results; one of them is enough.
    cut = (cut if real else cut.drop("kept")).dropDuplicates(["o", "h1"])
    each = info.groupBy("o", "h1", "h2").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.first("sha").alias("sha"), F.count(F.lit(1)).alias("times")
    )
    heads = info.groupBy("h1", "h2").agg(F.min("o").alias("head"))
    out = each.join(heads, ["h1", "h2"]).join(cut, ["o", "h1"], "left")
    out = out.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    is_copy = ((F.col("o") != F.col("head")) | (F.col("turn") > 1)) & (F.col("n_bytes") >= LENGTH)
    empty = hashlib.sha256(b"").hexdigest()
    result = out.select(
        "doc_id", "n_bytes",
        F.when(is_copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(is_copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(is_copy, F.lit(empty)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
        *([F.when(is_copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept"), "o", "h1"] if real else []),
    )
    if not real:
        return result
    whole = texts.unionByName(rows.where(F.octet_length("text") < LENGTH).select("o", "h1", "text")).dropDuplicates(["o", "h1"])
    result = result.join(whole, ["o", "h1"])
    return result.withColumn("kept", F.coalesce("kept", F.encode("text", "utf-8"))).drop("o", "h1", "text")
