"""Stages of the corpus pipeline: each applies one operator and lets its decisions take effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silkmill.llm.common import as_doc, from_doc


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification: rejected documents go."""
    from silkmill.llm.langid import fit_packed, identify

    packed = docs.select(as_doc(docs), F.col("text"))
    known = identify(packed, fit_packed(docs))
    return known.where(~F.col("rejected")).select(*from_doc(docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: texts lose their repeated blocks; documents that lose every word go."""
    from silkmill.llm.line_dedup import dedup_lines

    own = ["doc_id", "text", *[c for c in docs.columns if c == "n_chars"]]
    rest = [c for c in docs.columns if c not in own]
    out = dedup_lines(docs.select(*own, F.struct(*[F.col(f"`{c}`") for c in rest]).alias("doc") if rest else F.lit(None).alias("doc")))
    gone = (F.col("_n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    back = [F.col(c) if c in own else F.col("doc").getField(c).alias(c) for c in docs.columns]
    return out.where(~F.coalesce(gone, F.lit(False))).select(*back)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each group, the document with the least doc_id stays."""
    from silkmill.llm.simhash import drop_near_duplicates

    return drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: one row per document and round of the mix, with the words that the round takes."""
    from silkmill.llm.mixing import mix

    return mix(docs).texts()


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE: token ids, their number and digests, instead of the text."""
    import public_tokenizers

    from silkmill.llm.bpe import encode_decode

    return encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), token_ids=True).drop("text")


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("bpe", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result but the last is stored as a compressed table."""
    from silkmill.llm.common import stored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = stored(docs) if n < len(STAGES) - 1 else docs
    return docs
