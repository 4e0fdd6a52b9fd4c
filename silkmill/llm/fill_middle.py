"""Fill-in-the-middle: texts cut at line ends into prefix, middle and suffix, and put in another order.

The texts of an Arrow batch lie in one run of bytes.  Two bitvectors over that run, packed 64 to
a word, mark the last byte of every line and the first byte of every code point; a directory holds
the popcount before each block of words.  ``rank`` counts the ones before a byte: between a
text's ends it gives the number of its lines, and of code points before a cut.  ``select`` finds
the byte of a one by its rank: that is where a text is cut.  Both answer for all texts of a batch
at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silkmill.llm.common import as_doc, from_doc, small_batches

MARKS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM_SHARE = 7, 100, 50
#: Words of 64 bits in a block of the popcount directory.
BLOCK = 8
KINDS = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}


class BitVector:
    """Packed bits with a directory of the ones before each block."""

    def __init__(self, flags: np.ndarray):
        packed = np.packbits(flags, bitorder="little")
        room = np.zeros((len(flags) // (512 * BLOCK // 8) + 1) * BLOCK * 8, np.uint8)
        room[: len(packed)] = packed
        self.words = room.view(np.uint64).reshape(-1, BLOCK)
        each = np.bitwise_count(self.words).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(each)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block, word, bit = at >> 9, (at >> 6) & 7, (at & 63).astype(np.uint64)
        words = self.words[block]
        whole = np.bitwise_count(words) * (np.arange(BLOCK) < word[:, None])
        last = words[np.arange(len(at)), word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[block] + whole.sum(axis=1, dtype=np.int64) + np.bitwise_count(last)

    def select(self, rank: np.ndarray) -> np.ndarray:
        """Position of the one that has ``rank`` ones before it."""
        block = np.searchsorted(self.before, rank, side="right") - 1
        left, row = rank - self.before[block], np.arange(len(rank))
        words = self.words[block]
        up_to = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        word = (up_to <= left[:, None]).sum(axis=1)
        left = left - np.where(word > 0, up_to[row, word - 1], 0)
        bits = np.unpackbits(np.ascontiguousarray(words[row, word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bit = (np.cumsum(bits, axis=1) <= left[:, None]).sum(axis=1)
        return (block << 9) + (word << 6) + bit


def _of(texts: pa.Array, h1: pa.Array, h2: pa.Array, forms: pa.Array, marks: tuple[str, str, str]) -> pa.StructArray:
    texts = pc.fill_null(texts, "")
    texts = texts if pa.types.is_large_string(texts.type) else texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    first, last = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    ends = data == 10
    ends[last[last > first] - 1] = True
    lines, chars = BitVector(ends), BitVector((data & 0xC0) != 0x80)
    begin = lines.rank(first)
    n = lines.rank(last) - begin
    cuts = np.sort(np.stack([x.to_numpy(zero_copy_only=False).astype(np.int64) % (n + 1) for x in (h1, h2)]), axis=0)
    ranks = np.maximum(begin + cuts - 1, 0)  # the one that ends the cut's last line; no line, no one
    at = np.stack([np.where(c > 0, lines.select(r) + 1 if len(data) else 0, first) for c, r in zip(cuts, ranks, strict=True)])
    known = chars.rank(first)
    upto = [chars.rank(x) - known for x in at]
    p, s, m = (x.encode() for x in marks)
    view, kind, out = memoryview(data), forms.to_pylist(), []
    for k, a, b, c, d in zip(kind, first.tolist(), at[0].tolist(), at[1].tolist(), last.tolist(), strict=True):
        if k == "plain":
            out.append(bytes(view[a:d]))
        elif k == "psm":
            out.append(b"".join((p, view[a:b], s, view[c:d], m, view[b:c])))
        else:
            out.append(b"".join((s, view[c:d], p, view[a:b], m, view[b:c])))
    plain = pc.equal(forms, "plain").to_numpy(zero_copy_only=False)
    counts = [pa.array(x, pa.int64(), mask=plain) for x in (upto[0], upto[1] - upto[0])]
    arrays = [pa.array(n, pa.int64()), forms, *counts, pa.array(out, pa.binary()).cast(pa.string())]
    return pa.StructArray.from_arrays(arrays, names=list(KINDS))


def fill_middle(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM_SHARE, marks: tuple[str, str, str] = MARKS
) -> DataFrame:
    """Adds ``n`` (lines), ``form``, ``prefix_chars``, ``middle_chars`` (code points) and ``output``, the rearranged text.

    The first four groups of eight hex digits of sha256(``seed:doc_id``) choose: two cuts among n + 1
    places, whether the text stays plain (``rate`` of 100 do not), and the order (``spm`` of 100 put
    the suffix first).  Empty texts and texts that hold a mark stay plain, with null lengths.  Null texts
    are empty, a null id is written as nothing after the colon.  Rows are independent: repeated rows
    give repeated results, an empty table an empty one, a long text is one row of one batch.  Columns
    of the input stay, but for ones with these names.  Ids of any type that has a decimal text form.
    """
    small_batches(docs.sparkSession)
    kinds = ", ".join(f"{n}: {k}" for n, k in KINDS.items())

    @F.arrow_udf(f"struct<{kinds}>")
    def of(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, h1, h2, forms in batches:
            yield _of(texts, h1, h2, forms, marks)

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    groups = [F.conv(F.substring("_digest", 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    body = F.coalesce(F.col("_text"), F.lit(""))
    plain = (body == "") | (F.col("h3") % 100 >= rate)
    for mark in marks:
        plain = plain | F.contains(body, F.lit(mark))
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    rows = docs.select(as_doc(docs), F.col(text).alias("_text"), digest.alias("_digest")).select("doc", "_text", *groups)
    rows = rows.select("doc", of(F.col("_text"), F.col("h1"), F.col("h2"), form).alias("found"))
    return rows.select(*from_doc(docs, *KINDS), *[F.col("found").getField(x).alias(x) for x in KINDS])


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text again.  No mark lies in a text that was rearranged, so the first of each divides."""
    p, s, m = (re.escape(x) for x in marks)
    psm = F.regexp_replace(output, rf"(?s)\A{p}(.*?){s}(.*?){m}(.*)\z", "$1$3$2")
    spm = F.regexp_replace(output, rf"(?s)\A{s}(.*?){p}(.*?){m}(.*)\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
