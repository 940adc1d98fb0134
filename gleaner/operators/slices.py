"""Windows over keys that may hold a large part of all rows: slices of a key in order, with what earlier and later slices carry over."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.session import checkpoint

SLICE = "_slice"
#: Keys of fewer rows are never sliced.
LEAST = 10_000


def sliced(rows: DataFrame, keys: Sequence[str], position: str, least: int = LEAST) -> DataFrame:
    """``rows`` (written once) with the number of a slice: 0, but for keys of more than half a partition's share of the rows.

    Such a key is cut at about equal numbers of rows by the column ``position`` (a number; rows at one position stay together), slices ascending.
    There are fewer of these keys than twice the shuffle partitions, with at most as many slices each, so the table of their cuts is broadcast.
    """
    rows = checkpoint(rows)
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(least, rows.count() // (2 * partitions))
    hot = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > share)
    most = hot.agg(F.max("_n")).first()[0]
    if most is None:
        return rows.withColumn(SLICE, F.lit(0))
    parts = min(2 * partitions, most // share + 1)
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    large = rows.alias("r").join(F.broadcast(hot).alias("h"), same("r", "h")).select("r.*")
    cuts = F.percentile_approx(position, [i / parts for i in range(1, parts)], 10 * parts)
    # written once: both uses of a plan must see the same cuts
    table = large.groupBy(*keys).agg(F.array_distinct(cuts).alias("_cuts"))
    # a row looks among every so many cuts, and then among those between two of them
    every = int(parts**0.5) + 1
    table = checkpoint(table.withColumn("_far", F.filter("_cuts", lambda c, i: i % every == 0)))
    passed = lambda a: F.size(F.filter(a, lambda c: c < F.col(f"r.{position}")))
    inner = lambda k: F.when(k > 0, (k - 1) * every + passed(F.slice("_cuts", (k - 1) * every + 1, every))).otherwise(0)
    number = F.coalesce(F.get(F.transform(F.array(passed("_far")), inner), F.lit(0)), F.lit(0))
    return rows.alias("r").join(F.broadcast(table).alias("c"), same("r", "c"), "left").select("r.*", F.when(F.col("_cuts").isNull(), 0).otherwise(number).alias(SLICE))


def carried(rows: DataFrame, keys: Sequence[str], **values: tuple[Column, Column, bool]) -> DataFrame:
    """``rows`` with columns of what other slices of the same key carry: name=(per slice, over slices, whether later ones count, else earlier).

    The first expression aggregates a slice, and the second folds these values (a column of the name) over a window of slices.  Only
    keys of several slices carry anything: at most as many rows as ``sliced`` makes slices, so they are broadcast.
    """
    sums = rows.groupBy(*keys, SLICE).agg(*(first.alias(name) for name, (first, _, _) in values.items()))
    whole = Window.partitionBy(*keys)
    sums = sums.withColumn("_many", F.count("*").over(whole)).where("_many > 1").drop("_many")
    earlier = whole.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    later = whole.orderBy(SLICE).rowsBetween(1, Window.unboundedFollowing)
    told = sums.select(*keys, SLICE, *(fold.over(later if after else earlier).alias(name) for name, (_, fold, after) in values.items()))
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}")) for k in (*keys, SLICE)]
    return rows.alias("r").join(F.broadcast(checkpoint(told)).alias("t"), on, "left").select("r.*", *(f"t.{name}" for name in values))
