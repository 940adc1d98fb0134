"""Deduplication, containment and merging of findings."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.slices import LEAST, SLICE, carried, sliced


def first_of_each(findings: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """One finding of each key: the first by ``order``, the same on every run.

    An aggregation, not a window: each task keeps one finding per key before the shuffle, so a key with a
    third of all findings costs no more than others.
    """
    row = F.struct(*findings.columns)
    return findings.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("_first")).select("_first.*")


def first_per_secret(findings: DataFrame, order: list[Column], kind: str = "kind", secret: str = "secret") -> DataFrame:
    """One finding of each (rule, origin kind, secret): the first by ``order``."""
    return first_of_each(findings, [F.upper("rule_id").alias("_rule"), F.col(kind).alias("_kind"), F.col(secret).alias("_secret")], order)


def origin_rows(findings: DataFrame, keys: list[str], origins: str = "origins") -> DataFrame:
    """(keys, origin), distinct: where each key was found, as rows of their own.

    The form for keys found at any number of places; ``merge_origins`` holds the places of a key in one row.
    """
    return findings.select(*keys, F.explode(origins).alias("origin")).distinct()


def merge_origins(findings: DataFrame, keys: list[str], order: list[str], origins: str = "origins") -> DataFrame:
    """One row per key: the first finding by ``order``, with the distinct origins of all in one array."""
    rest = [c for c in findings.columns if c not in (*keys, origins)]
    first = findings.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    places = origin_rows(findings, keys, origins).groupBy(*keys).agg(F.array_sort(F.collect_list("origin")).alias(origins))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    joined = first.alias("a").join(places.alias("b"), same)
    return joined.select(*(F.col(f"a.{k}").alias(k) for k in keys), F.col(f"b.{origins}").alias(origins), "a._first.*")


def one_row_per_origin(findings: DataFrame, origins: str = "origins") -> DataFrame:
    """Every origin of a finding as a row of its own."""
    return findings.withColumn("origin", F.explode(origins)).withColumn(origins, F.array("origin"))


def without_redundant_git(origins: Column) -> Column:
    """Git origins without a commit go where the same repository also has one with a commit."""
    detailed = F.filter(origins, lambda o: (o["kind"] == "git_repo") & o["commit"].isNotNull())
    known = F.transform(detailed, lambda o: o["repo_path"])
    return F.filter(
        F.array_distinct(origins),
        lambda o: ~((o["kind"] == "git_repo") & o["commit"].isNull() & F.array_contains(known, F.coalesce(o["repo_path"], F.lit("")))),
    )


def inside_another(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end", tie: list[str] = (), least: int = LEAST) -> DataFrame:
    """``spans`` with ``contained``: whether another span of the same keys begins no later and ends no earlier.

    Of equal spans the first (by ``tie``) stays free.  Spans are ordered by start (longest first), so the farthest end
    so far decides, and no pair of spans is formed.  A key with very many spans is cut into slices by their starts; the farthest end of the
    slices before is carried over.
    """
    rows = sliced(spans, keys, start, least)
    far = f"_far_{uuid.uuid4().hex[:8]}"
    rows = carried(rows, keys, **{far: (F.max(end), F.max(far), False)})
    w = Window.partitionBy(*keys, SLICE).orderBy(F.col(start), F.desc(end), *tie).rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(*spans.columns, F.coalesce(F.greatest(F.max(end).over(w), F.col(far)) >= F.col(end), F.lit(False)).alias("contained"))
