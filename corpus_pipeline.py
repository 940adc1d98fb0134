"""A corpus pipeline: toxicity, quality, near-duplicates, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``.  All but the last return the columns
of ``documents``.  Classifiers learn from ``labels`` (and ``documents``) in ``sf_dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import packing, quality, simhash, toxicity
from gleaner.llm.common import crc_mod, shared_folder, tables


def _without(docs: DataFrame, score, rejected) -> DataFrame:
    """The rows of ``docs`` whose score is not rejected, with the same columns."""
    name = f"_score_{uuid.uuid4().hex[:8]}"
    return docs.withColumn(name, score).where(~rejected(F.col(name))).drop(name)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half.

    Null and empty texts have the score of the share of toxic labels, so they stay where that is below one half.  Repeated rows are
    judged alike, so all stay or go; rows without an id are judged like others; very long texts are read whole; an empty
    table gives an empty one.  All columns are kept, whatever their names.
    """
    source, labels = tables(spark, sf_dir, "documents", "labels")
    model = toxicity.train(source, labels, crc_mod(F.col("doc_id"), 5) != 0)
    return _without(docs, toxicity.scorer(model)(F.col("text")), lambda s: s.score >= 0.5)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is one half or more.

    Null and empty texts have the score of no features.  Repeated rows are judged alike, so all stay or go; rows without an id are
    judged like others; very long texts are read whole; an empty table gives an empty one.  All columns are kept, whatever their names.
    """
    source, labels = tables(spark, sf_dir, "documents", "labels")
    model = quality.train(source, labels, crc_mod(F.col("doc_id"), 3) != 1)
    return _without(docs, quality.scorer(model)(F.col("text")), lambda s: s < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component the document with the smallest doc_id.

    Null, empty and blank texts are one component like any other.  Of repeated rows one stays; a row without an id stays only where
    its component has no id at all; of rows with the same id the one whose text has the smallest hash.  Very long texts are read
    whole; an empty table gives an empty one.  All columns are kept, whatever their names.
    """
    return simhash.representatives(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 1024 tokens.

    Null and empty texts are one piece of one token (the end).  Repeated rows and rows without an id are packed each for itself; very
    long texts are cut into pieces; an empty table gives an empty result.  Other columns play no part, whatever their names.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: SQL cannot express the fitted classifiers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    (docs,) = tables(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
