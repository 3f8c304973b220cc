"""A training-text pipeline: each stage works on what its predecessor kept.

Language identification drops texts without a recognisable language; of each group of near copies
one document stays; documents that hold a benchmark window go; secrets are masked in the text; what
is left is packed into sequences. All stages but the last return the columns of ``documents``.

Nulls, ties, repeated rows and very long texts are treated as the operators state: a null or empty text has no language and
goes in the first stage; rows with null or repeated ids are told apart by a key of their own; very long texts pass whole. An empty
table passes all stages as an empty one. Extra columns stay until the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cuesheet.llm import decontaminate, langid, neardup, packing, secrets
from cuesheet.llm.common import table
from cuesheet.plans.session import ship_package, stage


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return langid.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return neardup.keep_one(docs)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return secrets.mask_secrets(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_languages),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_benchmark_text),
    ("secret_scans", mask_secrets),
    ("packing", pack_sequences),
]

#: Kernel scores, MinHash and the genetic algorithm are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
