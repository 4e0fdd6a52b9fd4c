"""BPE encoding and decoding of whole texts with the tokenization automaton."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silkmill.llm.bpe_automaton import MergeAutomaton, compiled, load  # noqa: F401
from silkmill.llm.common import as_doc, from_doc, pack, share, small_batches

#: Words of a generation whose path is kept (some 250 bytes each); of a full one, those met again go on to the next.
MEMO_WORDS = 60_000
#: Longer words are encoded each time.
MEMO_LENGTH = 64
#: Characters of text that are encoded before their results become Arrow arrays.
CHARS_AT_ONCE = 1 << 20

# Fixed values of the tokenizer file: white space (Unicode White_Space) and the word pattern.
SPACE = r"\t\n\x0B\f\r \x85\xA0  -     　"
# Letters newer than the tokenizers library's tables (Unicode 16).
NEWER = (
    r"\u0558\u058B-\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE-\uA7CF\uA7D2\uA7D4\uA7DD\uA7E2\uA7F1\uAB6C-\uAB6D"
    r"\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A"
    r"\U00011DB0-\U00011DDB\U00011DF1\U00016EA0-\U00016EB8\U00016EBB-\U00016ED3\U00016FF2-\U00016FF3"
    r"\U000187F8-\U000187FF\U00018CD6-\U00018CDA\U00018D09-\U00018D20\U00018D80-\U00018DF2"
    r"\U00018E00-\U00019191\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168\U0001D6A6"
    r"\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF"
    r"\U0001E6C0-\U0001E6DE\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5\U0001E6E7-\U0001E6ED"
    r"\U0001E6F0-\U0001E6F4\U0001E6FE-\U0001E6FF\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD"
    r"\U000323B0-\U00033479\U0003D000-\U0003FC3F"
)
# Capital letters of Unicode 16 and 17, which Python leaves as they are.
NEWER_LOWER = {c: c + 1 for c in (0x1C89, 0xA7CC, 0xA7CE, 0xA7D2, 0xA7D4, 0xA7DA)} | {0xA7CB: 0x264, 0xA7DC: 0x19B}
NEWER_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
LETTER, NUMBER = rf"[\p{{L}}--[{NEWER}]]", r"\p{N}"
OTHER = rf"(?:[{NEWER}]|[^{SPACE}\p{{L}}\p{{N}}])"
PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d|{LETTER}+|{NUMBER}|{OTHER}+"


def latin_pattern() -> str:
    """The word pattern for texts of Latin-1 characters, with its classes spelled out."""
    kinds = {c: unicodedata.category(c)[0] for c in map(chr, range(256))}
    letters, numbers = ("".join(f"\\x{ord(c):02x}" for c, k in kinds.items() if k == kind) for kind in "LN")
    space = r"\t\n\x0b\x0c\r\x20\x85\xa0"
    return rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+"


def byte_letters() -> dict[int, str]:
    """Byte to visible character: printable ones stand for themselves, others go from U+0100 up."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(0x100 + n) for n, b in enumerate(rest)}


class WordBpe:
    """Pre-splitting, automaton and memo of one tokenizer."""

    def __init__(self, automaton: MergeAutomaton, special: list[tuple[str, int]], labels: list[str | None]):
        self.automaton = automaton
        self.special = dict(special)
        self.labels = labels
        self.decimal = [str(i) for i in range(len(labels))]
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.piece = regex.compile(PIECE, regex.V1)
        self.latin = re.compile(latin_pattern())
        self.at_special = regex.compile("(" + "|".join(regex.escape(x) for x, _ in special) + ")") if special else None
        self.letters = byte_letters()

    def words(self, text: str) -> list[str]:
        """Words of a normalised text: NFC, lower case one character at a time, white space dropped."""
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        try:  # most texts; the general classes are slower
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.piece.findall(text.translate(NEWER_LOWER))
        return self.latin.findall(text)

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of a word."""
        if (out := self.memo.get(word)) is not None:
            return out
        if (out := self.older.get(word)) is None:
            if word.isascii() and word.isprintable():
                mapped = word
            else:
                mapped = "".join([self.letters[b] for b in word.encode("utf-8")])
            out = tuple(self.automaton.encode_word(mapped))
        if len(word) <= MEMO_LENGTH:
            if len(self.memo) >= MEMO_WORDS:  # the dicts stay the same objects: callers hold their methods
                self.older.clear()
                self.older.update(self.memo)
                self.memo.clear()
            self.memo[word] = out
        return out

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a text."""
        if not text:
            return []
        get, word = self.memo.get, self.word
        if not self.at_special or "<|" not in text:
            return list(chain.from_iterable([get(x) or word(x) for x in self.words(text)]))
        out: list[int] = []
        for n, piece in enumerate(self.at_special.split(text)):
            if n % 2:
                out.append(self.special[piece])
            else:
                out += chain.from_iterable([get(x) or word(x) for x in self.words(piece)])
        return out

    def decode(self, ids: list[int]) -> str:
        """Arc labels of the ids, joined by one space; unknown ids give nothing."""
        labels = self.labels
        try:
            return " ".join([labels[i] for i in ids])
        except (IndexError, TypeError):
            return " ".join([labels[i] for i in ids if 0 <= i < len(labels) and labels[i] is not None])


def packed_tokenizer(spark: SparkSession, path: str) -> bytes:
    """The tokenizer of a file, compiled in a task: the driver has its packed bytes only."""
    with open(path, "rb") as f:
        file = f.read()
    return spark.sparkContext.parallelize([file], 1).map(lambda x: pack(compiled(x))).first()


def encode_decode(docs: DataFrame, path: str, text: str = "text", token_ids: bool = False, decoded: bool = False) -> DataFrame:
    """Adds ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``; where asked for, also ``token_ids`` and ``decoded``.

    Null and empty texts have no tokens (the digests of the empty text).  Special tokens in a
    text become their ids.  Rows are independent: repeated rows give repeated results, an
    empty table an empty one.  Columns of the input stay, but for ones with these names.
    """
    small_batches(docs.sparkSession)
    model = share(docs.sparkSession, packed_tokenizer(docs.sparkSession, path))
    kinds = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    kinds |= {"token_ids": "array<int>"} if token_ids else {}
    kinds |= {"decoded": "string"} if decoded else {}

    @F.arrow_udf(f"struct<{', '.join(f'{n}: {k}' for n, k in kinds.items())}>")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = WordBpe(*model.load())
        sha, decimal = hashlib.sha256, bpe.decimal
        lists = pa.list_(pa.int32())

        def results(batch: pa.Array) -> pa.Array:
            counts, digests, decoded_digests, outs, ids_of = [], [], [], [], []
            for x in batch:
                ids = bpe.encode(x.as_py())
                out = bpe.decode(ids)
                counts.append(len(ids))
                digests.append(sha(" ".join([decimal[i] for i in ids]).encode()).hexdigest())
                decoded_digests.append(sha(out.encode("utf-8")).hexdigest())
                if token_ids:
                    ids_of.append(np.array(ids, np.int32))
                if decoded:
                    outs.append(out)
            arrays = [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded_digests, pa.string())]
            if token_ids:
                arrays.append(pa.array(ids_of, lists))
            if decoded:
                arrays.append(pa.array(outs, pa.string()))
            return pa.StructArray.from_arrays(arrays, names=list(kinds))

        for batch in texts:
            sizes = np.cumsum(_lengths(batch))
            cuts = [0, *(np.flatnonzero(np.diff(sizes // CHARS_AT_ONCE)) + 1).tolist(), len(batch)]
            parts = [results(batch.slice(a, b - a)) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield parts[0] if len(parts) == 1 else pa.concat_arrays(parts)

    out = docs.select(as_doc(docs), of(F.col(text)).alias("found"))
    return out.select(*from_doc(docs, *kinds), *[F.col("found").getField(x).alias(x) for x in kinds])


def _lengths(batch: pa.Array) -> np.ndarray:
    """Bytes of each text, 0 for null."""
    return pc.binary_length(batch).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
