"""What earlier runs have seen: a sketch of each run's keys that most new keys fail, and the keys for those that do not.

The sketch is a blocked Bloom filter kept as a table: a key sets one bit in each of eight words of one block.  It is built by an aggregation (``bit_or``
in the tasks first, then by block), so it may be of any size; where it is small it is broadcast, else joined by block.  Only keys that all eight bits
speak for are compared exactly, so the result has no error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import checkpoint

WORDS = 8
#: Bits of the sketch for each key; about one key of a thousand passes by chance.
BITS = 16
#: Blocks up to which a sketch is broadcast: 64 bytes each, and as much again for the row.
SMALL = 1 << 18


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bit(key: Column, word: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(key, F.lit(word)), F.lit(64)).cast("int"))


def sketch(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, w0 to w7) of the keys, for a number of blocks that is a power of two; null keys are left out."""
    rows = keys.where(F.col(key).isNotNull())
    return rows.groupBy(_block(F.col(key), blocks).alias("block")).agg(*(F.bit_or(_bit(F.col(key), i)).alias(f"w{i}") for i in range(WORDS)))


def blocks_for(count: int) -> int:
    """A power of two that gives each of so many keys ``BITS`` bits or more."""
    return 1 << max(4, (count * BITS // (64 * WORDS)).bit_length())


def record(keys: DataFrame, key: str, store: str, run: str) -> None:
    """Keeps the distinct keys of a run and their sketch below the folder ``store``; a run told again replaces itself."""
    known = checkpoint(keys.select(F.col(key).alias("key")).where("key is not null").distinct())
    blocks = blocks_for(known.count())
    known.write.mode("overwrite").parquet(f"{store}/keys/run={run}")
    sketch(known, "key", blocks).withColumn("blocks", F.lit(blocks)).write.mode("overwrite").parquet(f"{store}/sketch/run={run}")


def _sketches(spark: SparkSession, store: str) -> tuple[DataFrame, int]:
    """The sketches of all runs as one, of as many blocks as the largest has: a block of a smaller one stands for all blocks of its number modulo its size."""
    rows = spark.read.parquet(f"{store}/sketch")
    most = rows.agg(F.max("blocks")).first()[0] or blocks_for(0)
    copies = F.sequence(F.lit(0).cast("long"), (F.lit(most) / F.col("blocks")).cast("long") - 1)
    spread = rows.withColumn("block", F.explode(F.transform(copies, lambda i: F.col("block") + i * F.col("blocks"))))
    return spread.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS))), most


def judged(rows: DataFrame, key: str, store: str) -> DataFrame:
    """``rows`` with ``maybe``: false where no run in the store has seen the key, for sure; null keys are not seen."""
    all_runs, blocks = _sketches(rows.sparkSession, store)
    all_runs = checkpoint(all_runs)
    side = F.broadcast(all_runs) if all_runs.count() <= SMALL else all_runs
    names = [f"_w{i}" for i in range(WORDS)]
    side = side.select(F.col("block").alias("_block"), *(F.col(f"w{i}").alias(n) for i, n in enumerate(names)))
    hit = F.lit(True)
    for i, name in enumerate(names):
        hit = hit & (F.col(name).bitwiseAND(_bit(F.col(key), i)) != 0)
    joined = rows.withColumn("_at", _block(F.col(key), blocks)).join(side, F.col("_at") == F.col("_block"), "left")
    return joined.withColumn("maybe", F.coalesce(hit & F.col(key).isNotNull(), F.lit(False))).drop("_at", "_block", *names)


def unseen(rows: DataFrame, key: str, store: str) -> DataFrame:
    """The rows whose key no run in the store has; only those that the sketch speaks for reach the exact join."""
    told = judged(rows, key, store)
    known = rows.sparkSession.read.parquet(f"{store}/keys").select(F.col("key").alias(key)).distinct()
    sure, maybe = told.where("not maybe").drop("maybe"), told.where("maybe").drop("maybe")
    return sure.unionByName(maybe.join(known, key, "left_anti").select(sure.columns))
