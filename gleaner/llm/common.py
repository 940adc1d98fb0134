"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import checkpoint, shared_folder

__all__ = ["balanced_join", "checkpoint", "crc_mod", "fresh_name", "in_slices", "shared_folder", "split_join", "tables"]


def crc_mod(column: Column, modulus: int) -> Column:
    """crc32 of the column as text, modulo ``modulus`` (null for null)."""
    return F.crc32(column.cast("string").cast("binary")) % modulus


def in_slices(batches: Iterator[pd.DataFrame], text: str, budget: int = 8 << 20) -> Iterator[pd.DataFrame]:
    """Cut batches into runs of rows holding about ``budget`` characters of ``text``.

    Keeps the working memory of a task independent of how long the texts are:
    one slice holds either less than the budget or a single row.
    """
    for batch in batches:
        sizes = batch[text].map(lambda t: len(t) if t else 0).astype("int64")
        group = (sizes.cumsum() - sizes) // budget
        for _, rows in batch.groupby(group, sort=False):
            yield rows.reset_index(drop=True)


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in names]


def fresh_name(hint: str) -> str:
    """A column name that no table has, for columns added for a while."""
    return f"_{hint}_{uuid.uuid4().hex[:12]}"


def balanced_join(big: DataFrame, small: DataFrame, on: list[str], spread: str, rows: str) -> DataFrame:
    """Inner join of ``big`` with ``small``, which has one row per key and in ``rows`` how many rows of ``big`` have it.

    A key with more than half a partition's share of the rows is split by a hash of the column ``spread``, its
    row of ``small`` repeated for each part.  Such keys are fewer than twice the shuffle partitions, as their rows add up to
    no more than all, so the table of them is broadcast.  ``small`` is read three times; keys are not null.
    """
    spark = big.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = small.agg(F.sum(rows)).first()[0] or 0
    share = max(1000, int(total) // (2 * partitions))
    salts, salt = fresh_name("salts"), fresh_name("salt")
    hot = F.broadcast(small.where(F.col(rows) > share).select(*on, (F.col(rows) / share + 1).cast("int").alias(salts)))
    few = small.drop(rows).join(hot, on, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(salts, F.lit(1)) - 1))).drop(salts)
    many = big.join(hot, on, "left").withColumn(salt, F.pmod(F.xxhash64(spread), F.coalesce(salts, F.lit(1))).cast("int")).drop(salts)
    return many.join(few, [*on, salt]).drop(salt)


def split_join(big: DataFrame, small: DataFrame, key: str, spread: str, rows: str, total: int) -> DataFrame:
    """Inner join of ``big``, of ``total`` rows, with ``small``, which has one row per ``key`` and in ``rows`` how many rows of ``big`` have it.

    A key with more than half a partition's share of the rows is split by a hash of ``spread``, its row of ``small`` repeated for each
    part.  Such keys are fewer than twice the shuffle partitions, so they are written into the plan as they are, which
    stays as small as that of the plain join.  Keys are whole numbers and not null.  ``small`` is read twice.
    """
    partitions = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(1000, total // (2 * partitions))
    hot = small.where(F.col(rows) > share).select(key, rows).collect() if total > share else []
    if not hot:
        return big.join(small.drop(rows), key)
    keys, parts = [r[key] for r in hot], max(r[rows] for r in hot) // share + 1
    salt = fresh_name("salt")
    many = big.withColumn(salt, F.when(F.col(key).isin(keys), F.pmod(F.xxhash64(spread), F.lit(parts)).cast("int")).otherwise(0))
    few = small.drop(rows).withColumn(salt, F.explode(F.when(F.col(key).isin(keys), F.sequence(F.lit(0), F.lit(int(parts - 1)))).otherwise(F.array(F.lit(0)))))
    return many.join(few, [key, salt]).drop(salt)
