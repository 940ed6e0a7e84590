"""The corpus pipeline: from raw documents to packed training sequences.

Five stages, each one operator over all rows that the stage before it kept:
quality rules, line dedup, near-dedup, personal data, packing. Every stage
takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's ``docs``; all but the last return the columns
of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lossframe.llm.common import table
from lossframe.llm.line_dedup import drop_lines
from lossframe.llm.near_dedup import drop_near_duplicates
from lossframe.llm.packing import pack_documents
from lossframe.llm.pii_crf import redact, train_from
from lossframe.llm.quality_crf import keep_good, train_line_model
from lossframe.session import checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line field keep."""
    return keep_good(docs, train_line_model(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that stand earlier in the corpus, alike to 0.9; documents that lose their last word go."""
    return drop_lines(docs, percent=90, min_words=1)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return drop_near_duplicates(docs, width=5, percent=75)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets."""
    return redact(docs, train_from(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a training sequence of 1024 tokens."""
    return pack_documents(docs, "byte_bpe_50k.json", capacity=1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Trained fields and a byte-pair encoder are part of the stages: SQL cannot express the result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over its predecessor's Parquet, from ``documents`` on; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
