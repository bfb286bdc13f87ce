"""A corpus from documents to token ids: quality rules, near duplicates, personal data, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strainlake.llm import bpe, mixing, neardup, pii, quality
from strainlake.llm._common import Scratch, lasting, passing


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: sets of five-word shingles, similarity of 0.8 or more."""
    return neardup.deduplicated(docs, width=5, percent=80, coords=160, rows=5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities are removed from the texts, terms that disclose them generalised."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as their source's target takes them."""
    return mixing.mixture(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixed),
    ("bpe", token_ids),
]

#: Sketches, seeded hashes and a tokenizer's merges have no SQL; tests/llm holds the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), lasting(spark)
    with Scratch(spark) as scratch:
        for k, (_, stage) in enumerate(STAGES, 1):
            with passing():
                docs = (last if k == len(STAGES) else scratch).save(stage(spark, docs, sf_dir))
    return docs
