"""Corpus pipeline: toxic documents go, near copies go, personal data is masked, sources are mixed, texts become tokens.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns the documents that the next stage reads.  The last returns token ids.

All stages keep the columns of their input but the last, read texts of any length as a
whole, take null texts as empty, and give an empty result for an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from logforge.llm import jaccard_join, mixing, pii, sentencepiece_bpe, toxicity
from logforge.llm.storage import folder, save

TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from the labels of the documents still here.

    Repeated rows, and rows that share a doc_id, go or stay each by its text; a score of exactly 0.5 is toxic; rows
    without doc_id are scored but not learned from; null and empty texts stay.
    """
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that of the least doc_id, then of the least hash of its text.

    A similarity of exactly 0.8 is a link; of repeated rows one stays; rows without doc_id stay only where no row of
    their group has one; null and empty texts all stay.
    """
    return jaccard_join.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become the name of their kind; every row stays, and null and empty texts as they are."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents enter as often as the mix of their source takes them.

    A null source is one source; null and empty texts take no words; where a budget ends among repeated rows, as
    many of them are taken as it has room for.
    """
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed little-endian unsigned 32-bit integers) and the decoded text's digest, for every row, repeated ones too."""
    encoded = sentencepiece_bpe.encode_decode(docs, TOKENIZER)
    return encoded.selectExpr("doc_id", "n_tokens", "ids", "sha2(encode(decoded, 'UTF-8'), 256) as decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("pii", mask_personal_data),
    ("source_mixing", mix_sources),
    ("sentencepiece", tokenize),
]

#: MinHash, the fitted classifier and the tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    where = folder(spark)
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), where, name)
    return STAGES[-1][1](spark, docs, sf_dir)
