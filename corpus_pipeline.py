"""The corpus pipeline: five stages over ``documents``, each written as Parquet before the next one reads it.

A stage is (name, function); the function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of their input. Documents that the quality rules reject go; lines of ten or more documents go, and n_chars
follows the text; of each group of near-duplicates one document stays; personal data are masked; what is left is packed.
"""

from __future__ import annotations

from public_tokenizers import path as vocabulary_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, line_dedup, packing, pii, quality_rules, simhash_similar


def _with_length(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, with n_chars, where there is one, set to the text's length now."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*[F.col(f"`{c}`") for c in like.columns])


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_length(line_dedup.clean(docs, min_docs=10), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_similar.keep_first(docs, likeness=0.8, words=5)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_length(pii.mask(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary_path("byte_bpe_50k.json"), end_id=0, most_tokens=2048)


STAGES = [
    ("quality_rules", drop_bad),
    ("line_dedup", drop_lines),
    ("simhash", drop_near_copies),
    ("pii", mask_personal_data),
    ("packing", pack),
]

#: Tokenisation and the random field have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = common.step(spark, lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:  # a stage's result goes once the next one's is written
            common.forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
