"""Training-corpus pipeline: quality, toxicity, near-duplicates, mixing, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. Each stage's result is written as Parquet and read again
as the next one's ``docs``. All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidecorpus.llm import mixing, neardup, packing, quality, toxicity
from tidecorpus.llm.common import stored, table

QUALITY_AT = 0.3
TOXIC_AT = 0.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least ``QUALITY_AT``, learnt from ``labels``."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.scorer(model)("text") >= QUALITY_AT)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under ``TOXIC_AT``, learnt from ``labels``."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.scorer(model)("text") < TOXIC_AT)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (4-word shingles, at most 4 bits)."""
    return neardup.deduplicated(docs, shingle=4, max_bits=4).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights; one drawn in several epochs occurs as often."""
    return mixing.mixed(docs, **mixing.PRODUCTION).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of 2048 tokens."""
    out = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 2048, 0, keep_ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", keep_quality),
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", near_dedup),
    ("mixing", mix),
    ("best_fit_packing", pack),
]

#: SQL expresses neither the classifiers nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
