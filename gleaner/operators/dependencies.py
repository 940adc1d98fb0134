"""Values that one rule needs from another within the same blob."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.slices import LEAST, SLICE, carried, sliced


def dependency_values(matches: DataFrame, dependencies: DataFrame, blob: str = "blob_id") -> DataFrame:
    """(blob, rule_id, variable, value, start, end): for each rule found in a blob, what its dependencies found there."""
    needed = matches.select(blob, "rule_id").distinct().join(F.broadcast(dependencies), "rule_id")
    given = matches.select(blob, F.col("rule_id").alias("dep_rule_id"), F.col("secret").alias("value"), "start", "end")
    return needed.join(given, [blob, "dep_rule_id"]).select(
        blob, "rule_id", "dep_rule_id", F.upper("variable").alias("variable"), "value", "start", "end"
    )


def missing_dependencies(matches: DataFrame, dependencies: DataFrame, blob: str = "blob_id") -> DataFrame:
    """(blob, rule_id, dep_rule_id): dependencies that found nothing in a blob."""
    needed = matches.select(blob, "rule_id").distinct().join(F.broadcast(dependencies), "rule_id")
    there = matches.select(blob, F.col("rule_id").alias("dep_rule_id")).distinct()
    return needed.join(there, [blob, "dep_rule_id"], "left_anti").select(blob, "rule_id", "dep_rule_id")


def split_phases(matches: DataFrame, dependencies: DataFrame, blob: str = "blob_id") -> tuple[DataFrame, DataFrame]:
    """(simple, dependent): matches of blobs without and with a rule that has dependencies."""
    needing = dependencies.select("rule_id").distinct()
    blobs = matches.join(F.broadcast(needing), "rule_id", "left_semi").select(blob).distinct()
    return matches.join(blobs, blob, "left_anti"), matches.join(blobs, blob, "left_semi")


def nearest_value(targets: DataFrame, values: DataFrame, blob: str = "blob_id", least: int = LEAST) -> DataFrame:
    """For each target span the value whose start is nearest to its end, ties to the earlier value.

    An as-of join in both directions: targets and values of a blob are merged in order of position,
    and the last value before and the first after each target are read off two windows, so the
    work is linear in the rows of a blob.  A blob with very many rows is cut into slices; the last value of the slices before and the first
    of those after are carried over.
    """
    # of values at one position the first in order counts
    values = values.groupBy(blob, "start").agg(F.min("value").alias("value"))
    t = targets.select(blob, F.col("end").cast("long").alias("at"), F.lit(1).alias("side"), F.struct(*targets.columns).alias("target"), F.lit(None).cast("struct<start:bigint,value:string>").alias("v"))
    v = values.select(
        blob, F.col("start").cast("long").alias("at"), F.lit(0).alias("side"), F.lit(None).cast(t.schema["target"].dataType).alias("target"),
        F.struct(F.col("start").cast("long").alias("start"), F.col("value").alias("value")).alias("v"),
    )
    both = sliced(t.unionByName(v), [blob], "at", least)
    have = F.when(F.col("side") == 0, F.col("at"))
    both = carried(
        both, [blob], earlier=(F.max_by("v", have), F.last("earlier", ignorenulls=True), False), later=(F.min_by("v", have), F.first("later", ignorenulls=True), True)
    )
    order = ["at", "side"]
    back = Window.partitionBy(blob, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # backwards and from the end: a frame up to the end of a slice would be read again for every row
    ahead = Window.partitionBy(blob, SLICE).orderBy(*map(F.desc, order)).rowsBetween(Window.unboundedPreceding, 0)
    before, after = F.last("v", ignorenulls=True).over(back), F.last("v", ignorenulls=True).over(ahead)
    firsts = both.withColumn("before", F.coalesce(before, "earlier")).withColumn("after", F.coalesce(after, "later"))
    distance = lambda c: F.abs(F.col(f"{c}.start") - F.col("at"))
    nearer = F.when(F.col("after").isNull() | (distance("before") <= distance("after")), F.col("before")).otherwise(F.col("after"))
    return (
        firsts.where("side = 1").withColumn("near", nearer).where("near is not null")
        .select("target.*", F.col("near.start").alias("value_start"), F.col("near.value").alias("value"))
    )
