"""The corpus pipeline: five stages over documents, each written and read again before the next.

Every stage works on all rows that the one before kept, and all but the last return the columns of
documents. Intermediate tables go to the shared folder of spark.checkpoint.dir and are deleted when the driver ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plyframe.llm import decontaminate, langid, nearcopies, passages, sentencepieces
from plyframe.llm.common import table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go; ``lang`` becomes the predicted one."""
    return langid.keep_known(spark, docs, sf_dir)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word similarity 0.8) stays."""
    return nearcopies.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat an earlier document are cut."""
    return passages.cut_repeats(spark, docs, sf_dir)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.clean(spark, docs, sf_dir)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document gets its token ids."""
    return sentencepieces.encode(docs, sentencepieces.Encoder(sentencepieces.load()))


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", decontaminated),
    ("sentencepiece", encoded),
]

#: SQL can express neither suffix automata nor keyed merge-dropout; tests/llm/test_pipeline.py
#: checks every decision of its stages on planted rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage returns for the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
