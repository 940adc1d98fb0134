"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import checkpoint


@dataclass
class Sample:
    """``rows`` (doc_id, text, y), checkpointed; ``counts``: eligible labels by class; ``taken``: those sampled."""

    rows: DataFrame
    counts: dict
    taken: dict


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, per_class: int, eligible: Column | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> Sample:
    """At most ``per_class`` labelled documents of each class (0 and 1), chosen by a hash of their id.

    Labels without an id or of another value are ignored; an id labelled more than once counts
    with its largest label.  Only the chosen ids (bounded) are broadcast, so the texts
    of the corpus are read but not shuffled.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    if eligible is not None:
        known = known.where(eligible)
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(label).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y in sorted(counts):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        chosen = known
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(
        F.broadcast(chosen), F.col("doc_id") == F.col("_id")
    )
    rows = checkpoint(rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y"))
    taken = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    return Sample(rows, counts, taken)
