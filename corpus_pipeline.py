"""A corpus pipeline of five stages over documents: toxicity, exact dedup, near-dedup, mixing, tokenising.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.  Nulls, empty texts, repeated
rows, very long texts and empty tables are handled as the operators' docstrings say; a row with a null doc_id is never
taken for toxic or for a copy, and stands in the mixture once; other columns travel untouched.  run() writes what each
stage but the last returns to the shared checkpoint folder, so no stage is computed twice and a lost executor costs one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import byte_bpe, exact_dedup, minhash_dedup, mixing, toxicity
from spanloom.llm.common import read, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine rejects go; it learns from the labelled rows outside the held-out third."""
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays."""
    return exact_dedup.keep_first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five words, similarity 0.8) the one with the smallest doc_id stays."""
    return minhash_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated, at most twice; every document stays at least once."""
    return mixing.mix(docs, repeats=2.0)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of decoded bytes, one row for each row of the mixture."""
    return byte_bpe.digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", tokenise),
]

#: The first stage is a trained model, which SQL can't express; a test holds run() against a brute-force version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
