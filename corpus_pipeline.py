"""The corpus pipeline: from raw documents to token ids.

STAGES are applied in order; each gets what its predecessor kept, as a Parquet table
read again, and all but the last return the columns of ``documents``.

Rows are told by id and text: rows that share an id (a null one too) and differ in text are
different documents in every stage, and rows equal in both have one fate (near-duplicate removal keeps one of them).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkwarden.llm import bpe, common, decontaminate, simhash, substring, toxicity
from sparkwarden.llm.queries import BYTE_BPE


#: Smaller than on their own, as workers also hold what earlier stages have left.
BLOCK_BYTES, KEEP_UNITS = 3 << 20, 120_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from ``labels``, doesn't reject."""
    return toxicity.reject(docs, common.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: that with the smallest id."""
    return simhash.deduplicate(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has."""
    return substring.remove(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no notable part of a ``benchmark`` item."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left: doc_id, n_tokens, ids_sha256, decoded_sha256, ids."""
    return bpe.encode_documents(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN, block_bytes=BLOCK_BYTES, keep_units=KEEP_UNITS)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("bpe_encoding", encode),
]

#: A learnt classifier and fingerprints of 64 majorities aren't for SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage keeps on its way is deleted when its table is written."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.settled(spark, lambda f=stage, d=docs: f(spark, d, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
